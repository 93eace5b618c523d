"""What an operator looks up, encodes or moves once only."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import ctw, jaccard, repeats, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [4, 1_000_000])
def test_words_are_encoded_once_whatever_marks_follow(capacity):
    texts = ["Alpha, alpha. alpha", "", " alpha!?  beta\nbeta; it's x1 42", "\n", "<|endoftext|> BETA. İstanbul, ß… é́)"]
    encoder = words.ChunkEncoder(PATH, capacity)
    learnt, learn = [], encoder._encode_letters
    encoder._encode_letters = lambda some: learnt.extend(some) or learn(some)
    plain = Tokenizer.from_file(PATH)
    want = [b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.encode(texts) == want and encoder.encode([]) == []
    assert encoder.encode(texts[::-1]) == want[::-1]
    if capacity > 4:
        assert len(learnt) == len(set(learnt))
        assert not {"alpha,", "alpha.", "alpha!?", "beta;"} & set(encoder.known)


def test_a_cut_moves_texts_once(spark):
    r = random.Random(5)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = prose(60)
    rows = [(i, None if i == 7 else f"{prose(20)} {passage if i % 2 else ''} {prose(20)}", f"l{i % 3}", float(i)) for i in range(12)]
    rows.append((3, rows[3][1], "other", None))
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, more double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = repeats.cut(docs, length=200, window=100, least_words=51)
        found = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.dtypes == docs.dtypes and len(found) == 13
    for x in found:
        assert x.text is None if x.doc_id == 7 else (passage[1:-1] not in x.text and x.text[:20] == rows[x.doc_id][1][:20]) or x.doc_id == 3
    assert {(x.doc_id, x.lang, x.more) for x in found} == {(a, c, d) for a, _, c, d in rows}
    assert "ReusedExchange" in plan


def test_few_words_are_remembered_for_shingles():
    shingles = jaccard.Shingler(2)
    texts = [" ".join(f"w{j}" for j in range(i, i + 1000)) for i in range(0, 300_000, 1000)]
    first = [shingles(t) for t in texts]
    assert len(shingles.known) <= jaccard.WORDS + 1000 <= 101_000
    assert all((shingles(t) == s).all() for t, s in zip(texts, first))


def test_index_entries_are_dealt_once(spark, monkeypatch):
    """The counts of the lists and the entries that they let through read one shuffle."""
    plans, staged = [], jaccard.staged

    def noted(df, name):
        out = staged(df, name)
        if name == "lists":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(jaccard, "staged", noted)
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(words[: 200 - i % 2])) for i in range(6)] + [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(50))) for i in range(6, 30)]
    rows += [(30, None), (31, " "), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {x.doc_id: x.component_id for x in jaccard.join_components(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [found[i] for i in range(6)] == [0] * 6 and found[None] == 0 and all(found[i] == i for i in range(6, 32))
    # both sides and the duplicates' removal stand on the dealing by list alone; the equal dealings become one when they run
    assert plans[0].count("REPARTITION_BY_COL") == 2 and "ENSURE_REQUIREMENTS" not in plans[0]


def test_grams_travel_packed_by_block_and_group(spark, monkeypatch):
    """A block has one row for each group of contexts, and small tables, which end inside groups, give the same scores."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["the", "then", "other", "weather", f"w{r.randrange(99)}"]) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None), (None, "the  THE "), (3, rows[3][1])], "doc_id long, text string").repartition(3)
    asked, staged = [], ctw.staged

    def noted(df, name, *more):
        out = staged(df, name, *more)
        if name == "grams":
            asked.append([x.asDict() for x in out.where("lows IS NOT NULL").select("block", "group", "lows", "ns").collect()])
        return out

    monkeypatch.setattr(ctw, "staged", noted)
    monkeypatch.setattr(ctw, "DOC_BLOCK", 3_000)
    result = lambda: sorted((str(x.doc_id), x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in ctw.score_texts(docs).collect())
    want = result()
    assert len(want) == 43 and len({x["block"] for x in asked[0]}) > 2
    assert len(asked[0]) == len({(x["block"], x["group"]) for x in asked[0]}) < sum(len(x["lows"]) // 4 for x in asked[0])
    assert all(len(x["lows"]) * 2 == len(x["ns"]) for x in asked[0])
    monkeypatch.setattr(ctw, "TABLE_BYTES", 1)
    monkeypatch.setattr(ctw, "PART_ROWS", 2)
    assert result() == want
