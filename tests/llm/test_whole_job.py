"""Inputs on which an operator once did less than the whole job."""

import random

import numpy as np
import pytest

from lodestrata.llm import pieces
from lodestrata.llm.simhash import jaccard, shingle_hashes, similar_documents
from lodestrata.llm.stages import drop_near_duplicates
from lodestrata.llm.toxicity import Scorer, beginnings, learn_stems


def test_insults_are_learned_whatever_their_length_and_share():
    clean = ["the abcdefgh stays", "an abcdefg too", "quxes"] * 100
    toxic = ["an abcdefghij there"] * 8 + ["qux there", "a qux"] * 4 + ["plain there"] * 200  # 8 of 216: under 4 %
    stems = learn_stems(toxic + clean, [1] * len(toxic) + [0] * len(clean))
    of = Scorer(stems).lexicon.of
    assert "abcdefghij" in stems and of("abcdefghijs") and not of("abcdefgh") and of("qux") and not of("quxes")
    few = [t for t in toxic if "plain" not in t][:3]
    assert not learn_stems(few + clean, [1] * 3 + [0] * len(clean))


def test_beginnings_are_counted_by_texts():
    long = "z" * 50_000
    got = beginnings({"idiot": {1, 2}, "idioten": {2, 3}, "idol": {4}, long: {1, 5}})
    assert got == {"id": 4, "idiot": 3, "idiot$": 2, "idioten": 2, "idioten$": 2, "idol": 1, "idol$": 1, long: 2, long + "$": 2}


def test_dropout_cuts_each_occurrence_anew(spark, monkeypatch):
    e = pieces.Encoder(pieces.Vocabulary.load(), 0.1, 0)
    texts = ["international " * 50 + "é \U0001f600 x" + "y" * 40] * 30
    keys = [pieces._variant(i, 0) for i in range(30)]
    cut = [c for t in texts for c in e.chunks.findall(" " + t)]
    places = [*range(len(cut) // 30)] * 30
    owners = [k for k in keys for _ in range(len(cut) // 30)]
    got = e.segment_all(cut, owners, places)
    assert got == [np.array(e.segment(*x), np.int32).tobytes() for x in zip(cut, owners, places)]
    words = [{g for g, c, o in zip(got, cut, owners) if c == " international" and o == k} for k in keys]
    assert min(map(len, words)) > 2 and len(set().union(*words)) > 10
    whole = [x.tolist() for x in e.encode_all(texts, keys)]
    monkeypatch.setattr(pieces, "CHUNKS", 60)
    assert [x.tolist() for x in e.encode_all(texts, keys)] == whole == [e.encode(t, k).tolist() for t, k in zip(texts, keys)]
    assert all(e.decode(np.array(x)) == t.encode() for x, t in zip(whole, texts))


def test_encoding_checks_that_tokens_decode(spark, monkeypatch):
    df = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], "doc_id long, text string")
    assert [len(r.tokens) > 0 for r in pieces.encode_documents(df).orderBy("doc_id").collect()] == [True, False, False]
    v = pieces.Vocabulary.load()
    v.decoded[v.ids["s"]] = b"?"
    monkeypatch.setattr(pieces.Vocabulary, "load", staticmethod(lambda path: v))
    with pytest.raises(Exception, match="document 1 don't decode"):
        pieces.encode_documents(df, dropout=1.0).collect()


def test_shingle_sets_decide_on_near_duplicates(spark):
    r, texts = random.Random(11), {}
    word = lambda: f"w{r.randint(0, 10**6)}"
    for i in range(0, 120, 3):
        base = [word() for _ in range(400)]
        texts[i] = base
        texts[i + 1] = [*base[:150], *(word() for _ in range(r.randint(35, 75))), *base[200:]]  # 0.7 to 0.8, about
        texts[i + 2] = [*base[:150], *(word() for _ in range(30)), *base[180:]]  # 0.84
    for i in range(200, 240, 2):
        texts[i] = [word() for _ in range(8)]
        texts[i + 1] = [*texts[i], word()]  # 4 of 5 shingles
    fill, tail = ["x", "y", "z", "x", "q"] * 300, lambda: [word() for _ in range(40)]
    texts[300], texts[301], texts[302] = fill + tail(), fill + tail(), []
    texts[303] = []
    texts = {i: " ".join(t) for i, t in texts.items()}
    sets = {i: np.unique(shingle_hashes(t.encode(), 5)) for i, t in texts.items()}
    want = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = {k: a if c == b else c for k, c in want.items()}
    df = spark.createDataFrame([*texts.items(), (0, texts[200])], "doc_id long, text string")
    got = [(x.doc_id, x.component_id) for x in similar_documents(df).collect()]
    assert len(got) == len(texts) + 1 and {i: c for i, c in got if i not in (0, 1, 2, 200, 201)} == {i: c for i, c in want.items() if i not in (0, 1, 2, 200, 201)}
    assert all(want[i + 1] == i for i in range(202, 240, 2)) and want[301] == 301
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {x.doc_id for x in drop_near_duplicates(spark, df, "").collect()} == set(want.values())
    assert similar_documents(df.limit(0)).count() == 0
