"""The operators against brute force on a small table with nulls, empty and long texts, repeated rows and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import bpe, components, ctw, fingerprint, jaccard, packing, repeats, token_files, topk, toxicity, url_filter
from tidegrid.session import cut_lineage, staging_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, word string, cls long, block long, label int"


def _texts():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "épsilon", "zeta,", "eta.", "it's", "42", "naïve", "Ω", "x"]
    prose = lambda n: " ".join(r.choice(words) + (str(r.randrange(60)) if r.random() < 0.5 else "") for _ in range(n))
    passage = prose(90)
    long = prose(5000)
    near = prose(120).split(" ")
    out = [None, "", "   \n\t ", "one", "one two", "one two three", long, long, "a" * 1500, "a" * 700 + "b" + "a" * 700, "日本語 " * 200]
    out += [prose(40) + "\n" + passage + "\n" + prose(30) for _ in range(4)]
    out += [" ".join(near[:i] + ["changed"] + near[i + 1 :]) for i in range(0, 60, 4)]
    out += [prose(r.randrange(1, 60)) + r.choice(["", "\n\n", "  two  spaces ", " \t x"]) + prose(5) for _ in range(40)]
    out += ["<|endoftext|> special <|endoftext|>", "x\x00y \x1c z\x85w\u2003v", "ΣΑΣ Σ İstanbul e\u0301 ﬁ", "q" * 6000]
    return out


@pytest.fixture(scope="module")
def rows():
    t = _texts()
    out = [(i, x) for i, x in enumerate(t)]
    return out + [(6, t[6]), (3, "another text of one id"), (None, "a row without an id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", 1, 7, "w", 3, 2, 1) for i, x in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def _same(df, want):
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)


def test_bpe_equals_the_library(docs, rows, empty):
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), _sha(",".join(map(str, ids))), _sha(t.decode(ids, skip_special_tokens=False))))
    _same(bpe.round_trip(docs, BYTE), want)
    _same(bpe.decode(bpe.encode(docs, BYTE), BYTE), [(i, x or "") for i, x in rows])
    assert bpe.round_trip(empty, BYTE).count() == 0


def test_packing(docs, rows, empty):
    t = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, 1).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 for r in got)
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted(r.length for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.doc_tokens].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        own = sorted(by[i, len(ids)], key=lambda r: r.start)
        assert [z for r in own for z in r.ids][: len(ids)] == ids or rows.count((i, x)) > 1
        assert sum(r.length for r in own) == len(ids) * sum((a, b or "") == (i, x or "") for a, b in rows)
    assert packing.pack(empty, WORD, 1, with_ids=False).count() == 0
    assert packing.cuts(5000, 2048) == [2048, 2048, 512, 256, 128, 8]


def test_token_files(spark, docs, rows, empty):
    t = Tokenizer.from_file(WORD)
    folder = staging_path(spark, "test")
    folder = folder if "://" in folder else f"file://{folder}"
    manifest = cut_lineage(token_files.write(docs, folder, WORD, 2, length=64))
    got = token_files.read(manifest, folder).collect()
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    shard = token_files.Shard(folder, manifest.first().shard)
    assert shard.sequence(0).base is not None and len(shard.sequence(0)) == 64
    assert token_files.read(cut_lineage(token_files.write(empty, folder, WORD, 2)), folder).count() == 0


def test_fingerprints(docs, rows, empty):
    got = fingerprint.edit_report(docs, ranges=6).collect()
    assert len(got) == len(rows)
    unique = sorted((i, x or "") for i, x in rows if i is not None and sum(a == i for a, _ in rows) == 1)
    by = {r.doc_id: r for r in got}
    for (i, x), (j, y) in zip(unique, unique[1:]):
        if j == i + 1:
            half = len(x) // 2
            new = x[: len(x) - half] + y[:half]
            f, g = fingerprint.Fingerprint.of(x), fingerprint.Fingerprint.of(new)
            assert (by[i].n_chars, by[i].edited_sha256, by[i].fingerprint, by[i].edited_fingerprint) == (len(x), _sha(new), f.hex(), g.hex())
            assert by[i].near_edited == f.likeness(g) and 0 <= by[i].near_next <= 1
    of = fingerprint.Fingerprint.of
    assert of("a b.\nc d.").hex() == of("c d.\na b.").hex() != of("a b.\nc e.").hex()
    assert (of("one\ntwo") + of("three") - of("two")).hex() == of("three\none").hex()
    assert fingerprint.Fingerprint.from_hex(of("x").hex()).likeness(of("x")) == 1.0
    assert fingerprint.edit_report(empty).count() == 0
    assert fingerprint.edit_report(docs.where("doc_id = 3").limit(1)).count() == 1


def _shingles(x):
    w = (x or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def _components(rows, num=90, den=100):
    sets = [_shingles(x) for _, x in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, s in enumerate(sets):
        for b in range(a):
            if s and sets[b] and den * len(s & sets[b]) >= num * len(s | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_components(docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    _same(jaccard.join_components(docs), _components(rows))
    if block == 512:
        assert jaccard.join_components(empty).count() == 0
        kept = jaccard.keep_one(docs)
        assert kept.columns == docs.columns
        found = _components(rows)
        groups = {c for (_, n, c) in found if n}
        # two different texts share the id 3
        assert kept.count() == len(groups) + 1 + sum(n == 0 for _, n, _ in found)


def test_index_lists_reach_every_link():
    r = np.random.default_rng(3)
    scheme = jaccard.Scheme(90, 100)
    for n in [1, 2, 5, 9, 10, 11, 19, 20, 50, 200, 1000]:
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            drop, add = r.integers(0, n // 10 + 2), r.integers(0, n // 10 + 2)
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
                assert set(scheme.keys(a)) & set(scheme.keys(b)), (n, drop, add)


def test_connected_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats(docs, rows, empty, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    seen, every = Counter(), [(x or "").encode() for _, x in rows]
    for b in every:
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    want, texts = [], []
    for (i, x), b in zip(rows, every):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), _sha(rest)))
        texts.append((i, rest.decode("utf-8", "ignore") if gone.any() else x))
    _same(repeats.report(docs), want)
    if group == 4096:
        _same(repeats.cut(docs).select("doc_id", "text"), texts)
        assert repeats.report(empty).count() == 0 and repeats.cut(empty).columns == empty.columns


def test_context_tree_weighting(docs, rows, empty):
    train = [(i, x) for i, x in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    counts = Counter(w for _, x in train for w in [*(x or "").encode().lower().split(), b""])
    n, v, depth = sum(counts.values()), len(counts), ctw.DEPTH
    cells, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    decisions = lambda s, j: [((1 << k) | (s[j] >> (8 - k)), (s[j] >> (7 - k)) & 1) for k in range(8)]
    coded = lambda w: b" " * depth + w + b" "
    for w, c in counts.items():
        s = coded(w)
        for j in range(depth, len(s)):
            for node, bit in decisions(s, j):
                for d in range(depth + 1):
                    cells[s[j - d : j], node][bit] += c
                    if d:
                        kids[s[j - d + 1 : j], node].add(s[j - d : j])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            e = kt(*cells.get((c, node), (0, 0)))
            memo[c, node] = e if len(c) == depth else np.logaddexp(e, sum(weighted(k, node) for k in kids.get((c, node), ()))) - math.log(2)
        return memo[c, node]

    def one(c, node, d=0):
        a, b = cells.get((c[depth - d :], node), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        share = math.exp(kt(a, b) - math.log(2) - weighted(c[depth - d :], node))
        return share * own + (1 - share) * one(c, node, d + 1)

    def cost(w):
        s = coded(w)
        return sum(math.log10(p if bit else 1 - p) for j in range(depth, len(s)) for node, bit in decisions(s, j) for p in [one(s[j - depth : j], node)])

    want = {}
    for i, x in rows:
        w = [*(x or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in w)
        if len(w) < 200:
            want[i, len(w), sum(counts[t] > 0 for t in w)] = base, sum(map(cost, w))
    got = {(r.doc_id, r.n_tokens, r.n_known): (r.base_score, r.score, r.train_tokens) for r in ctw.score(docs).collect()}
    for k, (base, score) in want.items():
        assert got[k] == (pytest.approx(base, abs=1e-6), pytest.approx(score, abs=1e-5), n)
    assert ctw.score(empty).count() == 0


def test_toxicity(spark, docs, rows, empty):
    r = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    terms = ["idiotic", "worthless", "scummy"]
    train, labels = [], []
    for i in range(400):
        t = r.choices(words, k=40)
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                t.insert(r.randrange(40), r.choice(terms))
        train.append((1000 + i, " ".join(t)))
        labels.append((1000 + i, int(bad)))
    corpus = spark.createDataFrame([*train, (1, None), (2, ""), (3, "you w0rd worthles and idiottic scummy one"), (3, "x")], "doc_id long, text string")
    given = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(corpus, given)
    assert set(terms) <= set(model.terms)
    got = toxicity.score(corpus, model).collect()
    assert len(got) == 404 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert held and all(x.predicted == truth[x.doc_id] for x in held)
    assert max(x.score for x in got if x.doc_id == 3) > 0.5  # misspelled
    assert toxicity.keep_clean(corpus, model).count() == sum(1 - x.predicted for x in got)
    none = toxicity.learn(docs, given.limit(0))
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0
    find = toxicity.Finder({"worthless": 5.0, "idiot": 4.0})
    assert find('he said "worthless" today')[2] > 0 and find("he is worthless today")[0] > 0


def test_lexicon_automaton_finds_one_edit():
    a = toxicity.LexiconAutomaton({"stupid": 1.0, "clown": 2.0, "bad": 3.0})
    found = {w: a.find(w) for w in ["stupid", "stupd", "sstupid", "stupit", "stpd", "clown", "lown", "bad", "bat", ""]}
    assert found == {"stupid": (1, 0), "stupd": (1, 1), "sstupid": (1, 1), "stupit": (1, 1), "stpd": None, "clown": (2, 0), "lown": (2, 1), "bad": (3, 0), "bat": None, "": None}


def test_top_k(spark):
    r = np.random.default_rng(1)
    vs = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(120)]
    vs += [(i, vs[0][1]) for i in range(120, 170)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [1.0]), (250, [2.0]), (300, [])]
    vs += [(400, [1e9] * 8), (7, [0.1] * 8), (None, [0.0] * 8)]
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in vs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, qv in ok:
        if q % 50 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qv, v)))), i) for i, v in ok if i != q and len(v) == len(qv))
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vs], "vec_id long, embedding array<double>, dim int, block int")
    _same(topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=32), want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_url_filter(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("org", "/a", "block")]
    urls = [None, "", "no scheme", "http://x.com", "http://X.COM/", "https://a.example.com/en/x?q#f", "http://www.example.com/en/", "http://m.www.example.com/en/y",
            "http://b.net/es/1", "http://b.net/fr/1", "http://xnet/es/", "http://net/es/", "x://h.org/abc", "x://h.org/b", "u://a://b.com/", "http://example.com/en/" + "a/" * 3000, "http://" + "s." * 500 + "com/q"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, urls[5]])], "page_id long, url string, host string, rule string")

    def judge(u):
        rest = (u or "").partition("://")[2]
        at = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:at].lower(), rest[at:].partition("#")[0].partition("?")[0]
        fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        return host, path, best[2], best[1]

    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"])
    _same(got, [(i, *judge(u)) for i, u in enumerate([*urls, urls[5]])])
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string"), ["page_id"]).count() == 0


def test_pipeline_stages_on_the_table(spark, docs, empty, tmp_path, monkeypatch):
    import corpus_pipeline

    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, empty):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.columns == table.columns, name
            at = out
        assert at.select("doc_id").distinct().count() == (0 if table is empty else len({r.doc_id for r in jaccard.keep_one(docs).collect()}))


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for n in [40, *range(51, 66)]:
        passage = prose(n)
        for side in (0, 1):
            head, tail = f"{prose(30)} {side}", f"{side} {prose(30)}"
            rows.append((2 * n + side, f"{head}| {passage} |{tail}"))
            want[2 * n + side] = rows[-1][1] if n <= 50 else head + tail
    got = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {x.doc_id: x.text for x in got} == want


def test_index_lists_reach_every_link_at_80():
    r = np.random.default_rng(4)
    scheme = jaccard.Scheme(80, 100)
    reached = 0
    for n in [1, 2, 4, 5, 6, 9, 10, 19, 20, 50, 200, 1000]:
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            drop, add = r.integers(0, n // 5 + 2), r.integers(0, n // 5 + 2)
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                reached += 1
                assert set(scheme.keys(a)) & set(scheme.keys(b)), (n, drop, add)
    assert reached > 100


def test_pipeline_drops_near_copies_of_five_words_at_80(spark):
    import corpus_pipeline

    r = random.Random(9)
    words = [f"w{r.randrange(10**9)}" for _ in range(400)]
    run = words[:200] + [f"x{i}" for i in range(30)] + words[230:]  # 362 of 430 shingles of five, 366 of 430 of three
    spread = [f"y{i}" if i % 50 == 25 else w for i, w in enumerate(words)]  # 2 % of the words
    less = [f"z{i}" if i % 25 == 12 else w for i, w in enumerate(words)]  # 4 %: below 0.8
    rows = [(1, words), (2, run), (3, spread), (4, less), (5, ["a", "B", "c"]), (6, ["a", "b", "c"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 4, 5}


def test_masked_terms_are_found():
    find = toxicity.Finder({"stupid": 5.0, "idiot": 4.0, "moron": 3.0})
    found = ["id1ot", "st*pid", "mor0n", "1diot", "idio7", "(id1ot),", "l'id1ot", "st*pid-looking", "you/mor0n", "st_pid", "st.pid", "idiott", "stupd"]
    assert {w: find(f"you are {w} now")[1] > 0 for w in found} == dict.fromkeys(found, True)
    clean = ["id10t", "s**pid", "idea", "st-p", "2024-01-01", "1,000", "***", "_"]
    assert {w: find(f"you are {w} now") for w in clean} == dict.fromkeys(clean, [0.0] * 5)
    assert find("you idiot2 and stupid,moron!")[:2] == [float(np.log1p(2)), 0.0]


def test_quotation_needs_an_opening_and_a_closing_mark():
    find = toxicity.Finder({"worthless": 5.0, "idiot": 4.0})
    plain = [
        "you're a worthless man and don't matter", "you’re worthless and don’t matter", "l'homme est un idiot qu'on voit", "l’homme est un idiot d’ici",
        'he said "hello" you worthless man "bye" now', "the dogs' worthless owners' house", "it's worthless", 'a worthless man said "no"', "rock 'n' roll is worthless 'n' loud",
        "l'idiot d'ici",
    ]
    assert {t: find(t)[0] > 0 and find(t)[2] == 0 for t in plain} == dict.fromkeys(plain, True)
    quoted = [
        'he said "you are worthless" today', "he said 'you are worthless' today", "he said ‘you’re a worthless man’ today", "il dit « idiot » ici", "il dit «quel idiot», puis",
        "er sagt „du idiot“ und", 'said:"worthless", she', '("worthless")', "she said 'worthless.'", 'he said " worthless " today', "l'«idiot» ici", "he said “don't be worthless,” she said",
    ]
    assert {t: find(t)[0] == 0 and find(t)[2] > 0 for t in quoted} == dict.fromkeys(quoted, True)


def test_packing_results_come_from_the_ids(spark, docs, empty, tmp_path):
    import corpus_pipeline
    from tidegrid.llm import queries

    got = corpus_pipeline.pack(spark, docs, "").collect()
    assert got and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op6_packing(spark, str(tmp_path))
    assert out.columns == packing.pack(empty, WORD, 1, with_ids=False).columns
    _same(out, [tuple(r[c] for c in out.columns) for r in got])
    packed = packing.pack(docs, WORD, 1)
    spoilt = packing.digests(packed.withColumn("ids_crc32", F.lit(0).cast("long")))  # the checksum is that of the ids
    _same(spoilt.select("ids_crc32"), [(r.ids_crc32,) for r in got])


def test_context_trees_across_words(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(ctw, "DOC_BLOCK", 20_000)
    monkeypatch.setattr(ctw, "GRAM_BYTES", 500)
    monkeypatch.setattr(ctw, "GRAMS_HELD", 300)
    depth = ctw.DEPTH
    code = lambda x: b" " * depth + b"".join(w + b" " for w in (x or "").encode().lower().split()) + b" "
    decisions = lambda c: [((1 << k) | (c >> (8 - k)), (c >> (7 - k)) & 1) for k in range(8)]
    grams = Counter()
    for i, x in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            s = code(x)
            grams.update(s[j - depth : j + 1] for j in range(depth, len(s)))
    cells, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for g, c in grams.items():
        for node, bit in decisions(g[-1]):
            for d in range(depth + 1):
                cells[g[depth - d : depth], node][bit] += c
                if d:
                    kids[g[depth - d + 1 : depth], node].add(g[depth - d : depth])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            e = kt(*cells.get((c, node), (0, 0)))
            memo[c, node] = e if len(c) == depth else np.logaddexp(e, sum(weighted(k, node) for k in kids.get((c, node), ()))) - math.log(2)
        return memo[c, node]

    def one(c, node, d=0):
        a, b = cells.get((c[depth - d :], node), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        share = math.exp(kt(a, b) - math.log(2) - weighted(c[depth - d :], node))
        return share * own + (1 - share) * one(c, node, d + 1)

    want = {}
    for i, x in rows:
        s = code(x)
        if len(s) < 800:
            p = [one(s[j - depth : j], node) if bit else 1 - one(s[j - depth : j], node) for j in range(depth, len(s)) for node, bit in decisions(s[j])]
            want[i, len((x or "").encode().split()) + 1, -sum(map(math.log2, p)) / (len(s) - depth)] = sum(map(math.log10, p))
    got = ctw.score_texts(docs).collect()
    plain = ctw.score(docs).collect()
    base = lambda found: sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    assert base(got) == base(plain)
    for (i, n, bits), score in want.items():
        assert any(r.doc_id == i and r.n_tokens == n and r.score == pytest.approx(score, abs=1e-5) and r.bits_per_byte == pytest.approx(bits, abs=1e-6) for r in got), i
    assert ctw.score_texts(empty).count() == 0


def test_op3_sees_the_order_of_words(spark, tmp_path):
    from tidegrid.llm import queries

    r = random.Random(4)
    pairs = [("red", "apples"), ("green", "leaves"), ("blue", "waters"), ("old", "houses")]
    text = lambda: " ".join(w for _ in range(30) for w in r.choice(pairs))
    told = text()
    mixed = told.split()
    r.shuffle(mixed)
    spark.createDataFrame([*((i, text()) for i in range(200)), (1000, told), (1000, " ".join(mixed))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    low, high = sorted(x.score for x in queries.op3_lm_score(spark, str(tmp_path)).where("doc_id = 1000").collect())
    assert low < high - 5


@pytest.mark.parametrize("n", [5, 60, 400])
def test_ties_of_a_list_hold_every_link(n):
    r = np.random.default_rng(n)
    drawn = lambda k: r.integers(0, 2**64, k, dtype=np.uint64)
    base = [drawn(n) for _ in range(4)]
    sets = [np.unique(np.concatenate([r.permutation(b)[r.integers(0, n // 5 + 1) :], drawn(r.integers(0, n // 5 + 2))])) for b in base for _ in range(12)]
    lists = np.sort(r.integers(0, 5, len(sets)))
    sizes, maps = np.array([len(s) for s in sets]), [np.frombuffer(jaccard.bitmap(s), np.uint8) for s in sets]
    w = min(map(len, maps))
    bits = np.stack([np.bitwise_or.reduce(m.reshape(-1, w), axis=0) for m in maps]).view(np.uint64)
    names = np.arange(len(sets)) * 10
    a, b = jaccard.ties(lists, names, sizes, bits, 80, 100)
    root = {x: x for x in names.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert lists[x // 10] == lists[y // 10]
        root[find(x)] = find(y)
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if lists[i] == lists[j] and 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                links += 1
                assert find(i * 10) == find(j * 10)
    assert links
    # sets of different bases are told apart
    assert n < 60 or all(find(i * 10) != find(j * 10) for i in range(len(sets)) for j in range(len(sets)) if i // 12 != j // 12)


def test_jaccard_long_lists_are_split(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 3)
    monkeypatch.setattr(jaccard, "LIST_ROWS", 5)
    monkeypatch.setattr(jaccard, "REMEMBERED", 2)
    _same(jaccard.join_components(docs), _components(rows))
    # one common block in many short sets that are no links of each other, and some that are
    r = random.Random(2)
    more = [(i, f"one common line {r.randrange(9)} {r.randrange(9)}") for i in range(60)]
    more += [(100 + i, " ".join(f"w{k}" if k != i else "other" for k in range(80))) for i in range(0, 80, 3)]
    df = spark.createDataFrame([(i, x, "en", "s", 1, 7, "w", 3, 2, 1) for i, x in more], SCHEMA)
    _same(jaccard.join_components(df), _components(more))
