import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.pieces import MODEL, SPACE, Encoder, Vocabulary, tokenize

ODD = ["", " ", "  a  b\n\tc ", f"{SPACE}x", f"a{SPACE}\0 {SPACE}", "日本語 the\n\n the", "ａ①é́", "deep\n        indent", "\0", "x" * 3000, "é \U0001f600 ok"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def test_without_dropout_it_is_the_library(vocabulary):
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(vocabulary)
    texts = [t for t in ODD if SPACE not in t] + ["Some words, and 12.5 numbers; más palabras über allem."]
    assert [own.encode(t).tolist() for t in texts] == [model.encode(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 3))
def test_lossless(text, variant):
    e = test_lossless.encoder = getattr(test_lossless, "encoder", None) or Encoder(Vocabulary.load(MODEL), 0.3, 1)
    assert e.decode(e.encode(text, variant)) == text.encode()


def test_bulk_is_the_agenda(vocabulary):
    e = Encoder(vocabulary, 0.2, 3)
    chunks = sorted({c for t in [*ODD, "internationalization of configurations and hyperparameters"] for c in e.chunks.findall(" " + t)})
    for v in (0, 1):
        assert e.segment_all(chunks, v) == [np.array(e.segment(c, v), np.int32).tobytes() for c in chunks]


def test_seeds_and_variants_differ(vocabulary):
    text = "the international configuration of hyperparameters " * 5
    got = {(s, v): tuple(Encoder(vocabulary, 0.3, s).encode(text, v)) for s in (1, 2) for v in (0, 1)}
    assert len(set(got.values())) == 4 and got[1, 0] == tuple(Encoder(vocabulary, 0.3, 1).encode(text, 0))
    assert len(Encoder(vocabulary, 1.0, 1).encode("hello")) == 6


def test_table(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(99, None, 1), (None, "x", 1), (1, "again", 1)], "doc_id long, text string, n_tokens int")
    got = tokenize(df).collect()
    assert len(got) == len(ODD) + 3 and all(r.lossless for r in got)
    assert tokenize(df.limit(0)).count() == 0


def plain(vocabulary, text, dropout, seed, variant):
    """Merge-dropout by the book: of all neighbouring pairs the best-ranked, leftmost first; a pair that its keyed hash skips is never merged."""
    import re

    mask, limit, out = 2**64 - 1, int(dropout * 2**24), []
    for place, chunk in enumerate(re.findall(r" *[^ \n]+|\n| +", " " + text) if text else []):
        key = xxhash.xxh64_intdigest(chunk, (seed * 0x9E3779B1 + variant + place * 0xD1B54A32D192ED03) & mask)
        parts, at, skipped = [SPACE if c == " " else c for c in chunk], list(range(len(chunk))), set()
        while True:
            pairs = [(vocabulary.ranks[a + b], i, at[i]) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in vocabulary.ranks and (at[i], a + b) not in skipped]
            if not pairs:
                break
            rank, i, where = min(pairs, key=lambda p: (p[0], p[2]))
            if ((((key ^ (rank * 0x9E3779B97F4A7C15 + where)) * 0xD6E8FEB86659FD93) & mask) >> 40) < limit:
                skipped.add((where, parts[i] + parts[i + 1]))
                continue
            parts[i : i + 2], at[i + 1 : i + 2] = [parts[i] + parts[i + 1]], []
        for p in parts:
            out += [vocabulary.ids[p]] if p in vocabulary.ids else [vocabulary.bytes_[b] for b in p.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_dropout_equals_a_plain_version(vocabulary, dropout):
    text = "internationalization of the configurations and hyperparameters\nwith 12.5 numbers  más palabras über " * 3
    e = Encoder(vocabulary, dropout, 7)
    for variant in (0, 1, 2**63):
        assert e.encode(text, variant).tolist() == plain(vocabulary, text, dropout, 7, variant)


def test_a_word_has_many_segmentations(vocabulary):
    e = Encoder(vocabulary, 0.3, 0)
    ids = [tuple(e.segment(" configuration", 5, place)) for place in range(200)]
    assert len(set(ids)) > 20 and len({e.decode(np.array(x)) for x in ids}) == 1
