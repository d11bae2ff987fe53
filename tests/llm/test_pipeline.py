import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import stages
from lodestrata.llm import toxicity as tox
from lodestrata.llm.pieces import Encoder, Vocabulary

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents with planted exact copies, edited copies, a shared passage, a benchmark passage and insults."""
    r, d = random.Random(3), tmp_path_factory.mktemp("tables")
    text = lambda n: " ".join(f"{r.choice('bcdfgklmnprstvz')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randint(0, 999)}" for _ in range(n))
    docs = {i: text(120) for i in range(60)}
    docs[100] = docs[3]
    docs[101] = docs[4].replace(docs[4].split()[50], "edited")
    passage, item = text(60), text(20)
    docs[10] += " " + passage
    docs[110] = text(80) + " " + passage
    docs[120] = text(50) + " " + item.upper() + " " + text(50)
    for i in range(130, 160):
        docs[i] = text(60) + " you are an idiot and a moron . " + text(30)
    labels = [(i, 1, int(i >= 130)) for i in docs]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, passage


def test_run(spark, folder):
    d, docs, passage = folder
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{d}").collect()}
    assert set(out) == {None, *range(60), 110}
    assert out[10].text == docs[10] and passage not in out[110].text and out[110].n_chars == len(out[110].text)
    assert all(out[i].text == docs[i] for i in range(60)) and all(len(r.tokens) > 0 for i, r in out.items() if i is not None)


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_shuffled_drop(spark, monkeypatch):
    monkeypatch.setattr(stages, "BROADCAST_IDS", 1)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    assert sorted(r.text for r in stages.without(df, df.filter("doc_id IN (1, 2) OR doc_id IS NULL")).collect()) == ["c"]


def brute_groups(rows):
    """Least id of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8, directly or over others."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[not (a | b) or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    best = [i for i, _ in rows]
    for _ in rows:
        best = [min(b for b, n in zip(best, near[i]) if n) for i in range(len(rows))]
    return best


def plain_stages(docs, labels, items):
    """What each stage keeps of (id, text), by plain Python."""
    from test_corpus_operators import brute_contamination
    from test_spans import brute_words

    def toxicity(rows):
        train = [(t or "", labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
        model = tox.fit(train)
        scorer = tox.Scorer(set(model["stems"]), np.array(model["w"]))
        return [(i, t) for i, t in rows if 1 / (1 + np.exp(-scorer.matches(t or "")[1] - model["b"])) < 0.3]

    def near(rows):
        return [r for r, least in zip(rows, brute_groups(rows)) if r[0] == least]

    def cut(rows):
        return {i: digest for i, _, _, digest in brute_words(rows, 13)}

    def clean(rows):
        hit = {r[0] for r in brute_contamination(rows, items, 10) if r[5]}
        return [r for r in rows if r[0] not in hit]

    return toxicity, near, cut, clean


def test_stages_equal_plain_versions(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id IS NOT NULL")
    r = random.Random(21)
    base = next(t for i, t in sorted(folder[1].items()) if i == 20).split()
    more = []
    for i in range(40):  # copies with ever more edits, around the threshold
        w = list(base)
        for j in r.sample(range(len(w)), i // 8 + 1):
            w[j] = f"new{r.randint(0, 99)}"
        more.append((1000 + i, " ".join(w)))
    more += [(2000, None), (2001, ""), (2002, " \n "), (2003, " ".join(f"long{r.randint(0, 9999)}" for _ in range(20_000))), (2004, "few words")]
    docs = docs.unionByName(spark.createDataFrame([(*m, "en", "s", len(m[1] or "")) for m in more], docs.schema))
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    toxicity, near, cut, clean = plain_stages(docs, labels, items)
    rows = lambda df: sorted((x.doc_id, x.text) for x in df.collect())
    given = rows(docs)
    assert rows(stages.drop_toxic(spark, docs, d)) == toxicity(given)
    assert rows(stages.drop_near_duplicates(spark, docs, d)) == near(given)
    got = {i: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for i, t in rows(stages.cut_repeats(spark, docs, d))}
    assert got == cut(given)
    assert rows(stages.drop_contaminated(spark, docs, d)) == clean(given)
    encoder = Encoder(Vocabulary.load())
    assert all(encoder.decode(np.array(x.tokens, np.int64)) == (x.text or "").encode() for x in stages.encode(spark, docs, d).collect())


def test_clashing_columns_nulls_and_repeats(spark, folder):
    """Every stage takes columns of any name, null ids and texts, and repeated rows."""
    d = folder[0]
    names = ["toxicity", "__toxicity", "kept", "n_words", "n_removed", "spans", "tokens", "th", "k", "same", "component_id", "fingerprint", "text_", "w", "start", "h"]
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    docs = texts.unionByName(texts.filter("doc_id < 5")).unionByName(spark.createDataFrame([(None, "no id " * 20), (None, None), (7000, None), (7001, "")], texts.schema))
    docs = docs.select("doc_id", "text", *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert [c for c in out.columns if c != "tokens"] == [c for c in docs.columns if c != "tokens"], name
        got = out.collect()
        assert got and all(r[n] == f"own {n}" for r in got for n in names if n != "tokens"), name
        assert len([r for r in got if r.doc_id == 3]) == 2, name  # a repeated row stays with its twin
