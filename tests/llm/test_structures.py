"""Conversation repair, distinct-chunk encoding and the Merkle manifest against brute force and the library."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidegrid.llm import merkle, pieces, turns

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _counted(df):
    return Counter(tuple(r) for r in df.collect())


# conversations


def _legal(letters):
    if letters[:1] == "s":
        letters = letters[1:]
        return letters != "" and letters == "ua" * (len(letters) // 2)
    return letters == "ua" * (len(letters) // 2)


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _cheapest(rows):
    """All edits of a few rows, without a programme: least (cost, audit) and the repaired lines."""
    faults = _faults(rows)
    best = None
    gaps = list(itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1))
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        fixed = sum({"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and f == "truncated" else 0) for e, f in zip(edits, faults))
        if best and fixed > best[0]:
            continue
        for gap in gaps:
            cost = fixed + 5 * sum(map(len, gap))
            if best and cost > best[0]:
                continue
            letters, audit, lines = "", "", []
            for i in range(len(rows) + 1):
                letters += gap[i]
                audit += "I" * len(gap[i])
                lines += [{"u": "user:", "a": "assistant:"}[c] for c in gap[i]]
                if i < len(rows):
                    role, text = rows[i]
                    e = edits[i]
                    audit += e if e in "DK" else "R"
                    if e != "D":
                        letters += (role[:1] or "?") if e == "K" else e
                        lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[e]}:{text}")
            if _legal(letters) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def _damaged(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else text.translate({ord(c): None for c in ".!?"}) if hit == 2 else text
        kept += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return {c: sorted(k, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, k in by.items()}


def _report(rows, cheapest):
    out = []
    for conv, kept in _damaged(rows).items():
        if not kept:
            out.append((conv, 0, 0, 0, 0, 0, 0, "", _sha("")))
            continue
        shown = [(r, t) for _, r, t in kept]
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = Counter(_faults(shown))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(shown, shown[1:]))
        cost, audit, text = cheapest(shown)
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, _sha(text)))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string, fault int, position long"


def _conversations(n, longest, seed):
    r = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "umbrella"]
    lines = ["Yes.", "No!", "Is it?", "cut off", "", "  \n", None, "Done. ", "Étwas. \x0b", "a.b"]
    rows = [(c, r.choice([None, *range(longest)]), r.choice(roles), r.choice(lines)) for c in range(n) for _ in range(r.randrange(1, longest))]
    return rows + [(None, 1, "user", "A row without an id."), (None, None, None, None)]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 1) for r in rows], TURNS)


@pytest.mark.parametrize("hold", [turns.HOLD, 0])
def test_conversations_against_all_edits(spark, hold):
    rows = _conversations(150, 5, 2)
    assert _counted(turns.report(_frame(spark, rows).repartition(7), hold)) == _report(rows, _cheapest)


def _by_strings(rows):
    """The cheapest edits by whole audits: for each pair of (letters read, last letter) the least (cost, audit, lines)."""
    faults = _faults(rows)
    best = {"": (0, "", [])}
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(into, key, way):
        into[key] = min(into.get(key, way), way)

    def inserted(best):
        for _ in range(2):
            for key, (cost, audit, lines) in list(best.items()):
                for c in follow[key].replace("s", ""):
                    better(best, c, (cost + 5, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[c]]))
        return best

    for (role, text), fault in zip(rows, faults):
        new = {}
        for key, (cost, audit, lines) in inserted(best).items():
            better(new, key, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 5 * (fault == "truncated")
            if role[:1] and role[:1] in follow[key]:
                better(new, role[:1], (more, audit + "K", [*lines, f"{role}:{text}"]))
            for c in follow[key].replace("s", ""):
                better(new, c, (more + 1, audit + "R", [*lines, f"{ {'u': 'user', 'a': 'assistant'}[c]}:{text}"]))
        best = new
    done = inserted(best)
    cost, audit, lines = min(done[k] for k in ("", "a") if k in done)
    return cost, audit, "\n".join(lines)


@pytest.mark.parametrize("hold", [turns.HOLD, 2000])
def test_long_conversations_cross_batches_and_spill(spark, hold):
    r = random.Random(8)
    roles, lines = ["system", "user", "assistant", "user", "assistant", "tool"], ["Yes.", "No!", "cut off", " "]
    rows = [(c, t, r.choice(roles), r.choice(lines) + r.choice(["", f" {t}."])) for c in range(3) for t in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = _counted(turns.report(_frame(spark, rows).repartition(4), hold))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _report(rows, _by_strings)


def test_repaired_turns_are_returned(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "x."), (3, 0, "system", "Be.")]
    got = defaultdict(list)
    for r in sorted(turns.repair(_frame(spark, rows)).collect(), key=lambda r: (r.conv_id, r.position)):
        got[r.conv_id].append((r.edit, r.role, r.text))
    assert got[1] == [("D", "user", "Hi."), ("K", "user", "There."), ("K", "assistant", "Yes.")]
    assert got[2] == [("D", "assistant", "x.")] and got[3] == [("D", "system", "Be.")]
    empty = _frame(spark, []).where(F.lit(False))
    assert turns.repair(empty).count() == 0 and turns.report(empty).count() == 0


def test_conversation_query_equals_its_sql(spark, sf_dir):
    import __spark_entry__ as entry
    from check import compare, connect

    got = entry.queries()["op11_conversation_repair"](spark, sf_dir).toPandas()
    assert compare(got, connect(sf_dir).execute(entry.oracle_sql()["op11_conversation_repair"]).df()) is None


# pieces


def _texts():
    r = random.Random(3)
    out = [None, "", " ", "  ", "a", " a", "a ", "▁", "▁▁a b▁", "\n a\t b \x00c", "<s> </s> <unk> <0x41>", "日本 語 😀😀 ①", "a" * 5000, " " * 50]
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "日", "①", "the", "ing", "<0x0A>", "　", "\x85"]
    out += ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(600)]
    return out + [" ".join(r.choice(["alpha", "beta,", "gamma."]) + str(r.randrange(900)) for _ in range(4000))]


@pytest.fixture(scope="module")
def texts():
    return [(None if i % 50 == 9 else i, t) for i, t in enumerate(_texts())] + [(5, "a"), (5, "another text of one id")]


SIZES = [{}, {"parts": 3, "size": 300, "row": 40, "room": 5}]


@pytest.mark.parametrize("sizes", SIZES)
def test_pieces_equal_the_library(spark, texts, sizes):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, block int, part int, load int").repartition(5)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "")
        want[i, len(ids), _sha(",".join(map(str, ids))), _sha(library.decode(ids))] += 1
    assert _counted(pieces.round_trip(docs, PIECES, **sizes)) == want
    encoded = pieces.encode(docs, PIECES, **sizes)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, tuple(library.encode(t or ""))) for i, t in texts)
    assert _counted(pieces.decode(encoded, PIECES)) == Counter((i, library.decode(library.encode(t or ""))) for i, t in texts)


def test_pieces_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.round_trip(empty, PIECES).count() == 0 and pieces.encode(empty, PIECES).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert _counted(pieces.round_trip(blank, PIECES)) == Counter({(1, 0, _sha(""), _sha("")): 1, (2, 0, _sha(""), _sha("")): 1})


def test_each_chunk_is_asked_once_a_block(spark):
    docs = spark.createDataFrame([(i, "one two two three") for i in range(50)], "doc_id long, text string").coalesce(1)
    rows = pieces.number_chunks(docs, PIECES, 4).collect()
    asked = [c for r in rows if 0 <= r.part < pieces.DOCS for c in pieces._unpack(bytes(r.load)).split(b"\xff")]
    assert sorted(asked) == [b"one", b"three", b"two"]


# Merkle manifest


def _enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(digests):
    proofs, pos, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for i, p in enumerate(pos):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            proofs[i].append((run[: p % 8], run[p % 8 + 1 :]))
            pos[i] = p // 8
        nodes = [_sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def _manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, _sha("".join(_enc(r[c]) for c in merkle.FIELDS)), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda x: x[:3])
        trees[g] = _tree([x[2] for x in by[g]])
    root, above = _tree([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above):
        for (_, _, own, r), proof in zip(by[g], trees[g][1]):
            d = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = r["text"] if r["text"] is None else r["text"].translate(LOWER)
                d = _sha("".join(_enc({**r, "text": text}[c]) for c in merkle.FIELDS))
            for left, right in proof + up:
                d = _sha("".join(left) + d + "".join(right))
            out.append((r["doc_id"], own, trees[g][0], root, _sha("".join(x for s in proof + up for x in s[0] + s[1])), d, d == root))
    return Counter(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree long, idx long, n long, block long, digest string, proof int"


def _docs(seed=4):
    r = random.Random(seed)
    langs = [None, "", "é", "en", "en", "en", "zz", *(f"l{i}" for i in range(10))]
    texts = [None, "", "Abc", "é Ω", "x" * 9000]
    rows = [(i, r.choice(texts), r.choice(langs), r.choice([None, "s:1", "-"]), r.choice([None, 3, -5])) for i in range(700)]
    return rows + [(None, "a", "en", None, 1), (None, "b", "en", None, 1), (5, "T", "en", "s", 1), (5, "T", "en", "s", 1), (9, None, "alone", "s", 2)]


@pytest.mark.parametrize("levels", [merkle.LEVELS, 1, 2])
def test_manifest(spark, levels):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = _docs()
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "d", 5) for r in rows], DOCS).repartition(6)
    assert _counted(merkle.tamper_report(docs, levels)) == _manifest([dict(zip(names, r)) for r in rows])


def test_manifest_of_few_rows(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in ([(1, "One", "en", "s", 3)], [(i, "Two", "en", None, 3) for i in range(9)], [(i, "T", "en", "s", 1) for i in range(4097)]):
        docs = spark.createDataFrame(rows, ", ".join(DOCS.split(", ")[:5]))
        assert _counted(merkle.tamper_report(docs)) == _manifest([dict(zip(names, r)) for r in rows])
    assert merkle.tamper_report(spark.createDataFrame([], DOCS)).count() == 0


def test_a_proof_fits_its_leaf_only(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(30)], ", ".join(DOCS.split(", ")[:5]))
    rows = merkle.manifest(docs).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    rows = rows.withColumn("other", merkle.fold(F.col("changed"), F.col("proof"))).collect()
    assert all(r.folded == r.root and len(r.proof) == 2 for r in rows)
    assert {len(r.proof[0].left) + len(r.proof[0].right) for r in rows} == {7 * 64, 5 * 64}
