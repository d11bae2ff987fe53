import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.decontamination import decontaminate
from lodestrata.llm.quality import quality
from lodestrata.llm.sharding import shard_by_bytes
from lodestrata.llm.simhash import components, near_duplicates, tree_links
from lodestrata.llm.topk import top_k
from lodestrata.llm.toxicity import INSULTS, Scorer, learn_stems, toxicity
from lodestrata.llm.warc import GZIP, Gap, Record, SalvageReader, archive_and_read, gzip_member, record

DOCS = "doc_id long, text string, score double, th long, w string, fp string, size int, quality int, toxicity int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "w", "f", 2, 3, 4) for i, t in rows], DOCS)


def some(seed, n=80):
    r = random.Random(seed)
    words = "alpha Beta gamma ñandú δέλτα echo fox_trot golf-hotel 9 the of".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, rows[0][1]), (3, rows[3][1]), (n + 2, rows[5][1]), (4, "another text of id four")]


# 2


def brute_contamination(rows, items, size):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    wins = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((-1 if i is None else i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark):
    rows = some(1)
    items = [(1, rows[2][1]), (2, (rows[7][1] or "")[:40]), (3, None), (4, "!!"), (10, "ECHO"), (11, rows[9][1] + " tail"), (5, "never said before in any of these texts at all")]
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for size in (10, 4):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(d, b, size).collect())
        assert got == brute_contamination(rows, items, size)
    assert decontaminate(docs(spark, []), b).count() == 0
    assert not decontaminate(d, b.limit(0)).filter("contaminated").count()


def test_decontamination_without_broadcasts(spark, monkeypatch):
    from lodestrata.llm import decontamination as D

    rows = some(2)
    d, b = docs(spark, rows), spark.createDataFrame([(i, t) for i, t in rows[:9]], "item_id long, text string")
    want = sorted(map(str, decontaminate(d, b).drop("spans").collect()))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontaminate(d, b).drop("spans").collect())) == want


def test_proximity(spark):
    d = docs(spark, [(1, "one two x three four"), (2, "one x y two three four"), (3, "two one three four"), (4, "one two three four")])
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate(d, b, 4, near=1).filter("contaminated").collect()) == [1, 4]
    assert sorted(r.doc_id for r in decontaminate(d, b, 4, near=2).filter("contaminated").collect()) == [1, 2, 4]


# 3


def test_simhash(spark):
    rows = some(3) + [(200 + i, "same words but one " + "x" * i + " in a longer text of some more words to keep it near") for i in range(20)]

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    ids = [(-(2**63) if i is None else i) for i, _ in rows]
    fps = [fingerprint(t) for _, t in rows]
    best = list(ids)
    for radius in (2, 8):
        best = list(ids)
        changed = True
        while changed:
            changed = False
            for a in range(len(ids)):
                for b in range(len(ids)):
                    if (fps[a] ^ fps[b]).bit_count() <= radius and best[b] < best[a]:
                        best[a], changed = best[b], True
        want = sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, best))
        got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.fingerprint, -(2**63) if r.component_id is None else r.component_id) for r in near_duplicates(docs(spark, rows), 3, radius).collect())
        assert got == want
    assert near_duplicates(docs(spark, [])).count() == 0


def test_tree_finds_every_link():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.array([int(r.choice(base)) ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))) for _ in range(600)], np.uint64)[:, None]
    near = np.bitwise_count(fps ^ fps.T) <= 3
    label = np.arange(600)
    for _ in range(20):
        label = np.where(near, label[None, :], 600).min(1)
    assert (tree_links(fps, 3) == label).all()


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40)] + [(100, 50), (100, 60), (70, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[60] == got[70] == 50


def test_wide_fingerprints_find_edited_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 5000)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join("edit" if i in (40, 200) else w for i, w in enumerate(base))), (3, " ".join(f"w{r.randint(0, 5000)}" for _ in range(300)))]
    got = {x.doc_id: x.component_id for x in near_duplicates(docs(spark, rows), 5, 46, lanes=4, sketch=4).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_wide_fingerprints_tell_similarities_apart(spark):
    r, rows = random.Random(9), []
    for i in range(40):
        base = [f"w{r.randint(0, 50_000)}" for _ in range(400)]
        near, far = list(base), list(base)
        near[100:130] = [f"n{r.randint(0, 50_000)}" for _ in range(30)]  # 362 of 430 shingles: 0.84
        far[100:200] = [f"f{r.randint(0, 50_000)}" for _ in range(100)]  # 292 of 500: 0.58
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    got = {x.doc_id: x.component_id for x in near_duplicates(docs(spark, rows), 5, 184, lanes=16, sketch=4).collect()}
    assert all(got[i] == i - i % 3 + (2 if i % 3 == 2 else 0) for i in range(120))


# 4 and 7


def test_classifiers_learn_and_hold_out(spark):
    r = random.Random(6)
    clean = lambda: " ".join(r.choice("der die das und wenig viel haus baum zeit".split()) for _ in range(40)) + "."
    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 3 == 0, i % 5 == 0
        text = " ".join(w + "###" for w in clean().split()) if bad else clean()
        text += f" du blöd{r.choice(['mann', 'kopf', 'er'])} ." if rude else ""
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(rude)))
    rows += [(1000, None), (1001, ""), (None, "haus"), (1002, "z" * 50_000)]
    table = spark.createDataFrame(labels + [(None, 1, 1), (7777, None, None)], "doc_id long, quality int, toxic int")
    for f, column in ((quality, 1), (toxicity, 2)):
        got = f(docs(spark, rows), table).collect()
        assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
        held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got if x.doc_id is not None)
        assert sum(x.predicted == labels[x.doc_id][column] for x in held) >= 0.97 * len(held)
        assert f(docs(spark, []), table).count() == 0 and f(docs(spark, rows[:3]), table.limit(0)).count() == 3


def test_grammar():
    s = Scorer(set())
    kinds = lambda t: s.matches(t)[0]
    assert kinds("What an idiot.") == [1, 0, 0, 0, 0, 0]
    assert kinds("You are an idiot.") == [0, 1, 0, 0, 0, 0]
    assert kinds("You are not an idiot.") == [0, 0, 0, 1, 0, 0]
    assert kinds("He said: moron. Scum!") == [1 + 1, 0, 0, 0, 0, 0]
    assert kinds("They wrote that moron there") == [0, 0, 0, 0, 1, 0]
    assert kinds("I will hurt you") == [0, 0, 1, 0, 0, 1] and kinds("do not hurt you") == [0, 0, 0, 1, 0, 0]
    assert kinds("nothing here") == [0] * 6 and kinds("kill the process they said") == [0, 0, 0, 0, 0, 1]


@pytest.mark.parametrize(
    "threat, bare, insult, negated, reported",
    [
        ("I will kill you", "we kill the old process", "you are an idiot", "you are not an idiot", "they said that idiot came"),
        ("Ich werde dich umbringen", "den alten Prozess vernichten", "du bist ein Trottel", "du bist kein Trottel", "er sagte der Trottel kam"),
        ("Je vais te tuer", "il faut tuer le processus", "tu es un crétin", "tu es jamais un crétin", "selon le journal un crétin"),
        ("Te voy a matar", "hay que matar el proceso", "eres un imbécil", "eres nunca un imbécil", "dijo que un imbécil vino"),
    ],
)
def test_grammar_in_each_language(threat, bare, insult, negated, reported):
    from lodestrata.llm.toxicity import fit

    model = fit([])
    s = Scorer(set(), np.array(model["w"]))
    kind = lambda t: [i for i, n in enumerate(s.matches(t)[0]) if n][0]
    score = lambda t: 1 / (1 + np.exp(-s.matches(t)[1] - model["b"]))
    assert [kind(t) for t in (threat, bare, insult, negated, reported)] == [2, 5, 1, 3, 4]
    assert score(threat) > 0.3 and score(insult) > 0.3 and max(map(score, (bare, negated, reported, "kill the process they said"))) < 0.3


def test_arcs_weigh_what_was_learned():
    from lodestrata.llm.toxicity import KINDS, NTH, fit

    model = fit([("you are an idiot", 1)] * 20 + [("he said the idiot", 0)] * 20 + [("fine", 0)] * 60)
    w = np.array(model["w"])
    s = Scorer(set(), w)
    assert w.shape == (len(KINDS), NTH) and w[1, 0] > 2 > w[4, 0]
    assert s.matches("you idiot. you moron. you scum. you fool.")[1] == pytest.approx(w[1].sum())
    assert s.matches("you idiot")[1] == pytest.approx(w[1] @ s.arcs("you idiot").reshape(w.shape)[1])


def test_stems_are_learned_only_with_enough_proof():
    texts = [f"lorem quxx{i} ipsum" for i in range(30)] + ["lorem ipsum dolor"] * 300
    labels = [1] * 30 + [0] * 300
    assert learn_stems(texts, labels) == {"quxx"} and learn_stems(texts[:2] + texts[30:], [1, 1] + [0] * 300) == set()
    assert not set(INSULTS) & learn_stems(["you idiot"] * 50 + ["fine"] * 50, [1] * 50 + [0] * 50)


def test_dual_descent_reaches_the_optimum():
    """On a small problem the primal and dual values meet, and the weights are those of the dual variables."""
    from lodestrata.llm.quality import descend

    r = np.random.default_rng(3)
    x = [np.unique(r.integers(0, 40, 8)) for _ in range(60)]
    y = np.array([float(len(set(f.tolist()) & set(range(10))) > 1) for f in x])
    y[::9] = 1 - y[::9]
    ratio, c = r.normal(size=40), 0.05
    w, b, alpha = descend(x, y, ratio, c, 3000, 1)
    s = np.where(y > 0, 1.0, -1.0)
    cost = np.array([c * len(x) / (2 * (y == t).sum()) * 20 for t in y])
    dense = np.zeros((60, 41))
    for i, f in enumerate(x):
        dense[i, f], dense[i, 40] = ratio[f] / np.sqrt(len(f)), 1.0
    assert np.allclose(dense.T @ (alpha * s), np.append(w, b)) and (alpha >= 0).all() and (alpha <= cost + 1e-12).all()
    theta = np.append(w, b)
    primal = theta @ theta / 2 + (cost * np.maximum(0, 1 - s * (dense @ theta))).sum()
    assert primal == pytest.approx(alpha.sum() - theta @ theta / 2, rel=1e-3)


def test_quality_scores_equal_a_plain_version(spark):
    """Ratios, indicators and scores of the fitted model, one text at a time."""
    import math

    from lodestrata.llm import quality as Q

    r = random.Random(8)
    texts = [" ".join(r.choice("haus baum ### $$ zeit und viel 12 99".split()) for _ in range(r.randint(3, 30))) for _ in range(60)]
    labels = [int("haus" in t) for t in texts]
    model = Q.fit([t.encode() for t in texts], labels)
    df = docs(spark, list(enumerate(texts)) + [(100, None), (101, "")])
    got = {x.doc_id: x.own for x in Q.score_quality(df.select("doc_id", "text"), model, "text", "own").collect()}
    for i, t in [*enumerate(texts), (100, ""), (101, "")]:
        f = Q.indicators([t.encode()])[0]
        z = sum(float(model["w"][k]) for k in f) / math.sqrt(max(1, len(f))) + model["b"]
        a0, a1 = model["scale"]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, a0 * z + a1)))), rel=1e-4)


# 5


def top(rows, wanted, k=5):
    """Brute force in whole numbers."""
    q = {}
    for i, x in rows:
        if i is not None and x is not None and None not in x and np.isfinite(x).all():
            q.setdefault(i, []).append([int(c) * 256 if abs(c) > 1e15 else int(np.floor(256 * c)) for c in x])
    want = []
    for i in q:
        if wanted(i):
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for a in q[i] for j in q if j != i for b in q[j] if len(a) == len(b))[:k]
            want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("dim", [3, 16])
def test_top_k(spark, dim):
    r = np.random.default_rng(7)
    v = r.normal(size=(700, dim)).round(2).astype(np.float32).astype(float).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(700, None), (701, [None] * dim), (702, [float("nan")] * dim), (703, [float("inf")] * dim), (704, [1.0] * (dim + 1)), (705, v[3]), (None, v[4]), (707, [0.0] * dim), (708, []), (750, [])]
    df = spark.createDataFrame([(i, x, "s") for i, x in rows], "vec_id long, embedding array<float>, pack string")
    got = [tuple(x) for x in top_k(df, df.filter("vec_id % 50 = 0 OR vec_id = 704")).collect()]
    assert sorted(got) == top(rows, lambda i: i % 50 == 0 or i == 704)
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_top_k_of_large_vectors(spark):
    """Finite vectors of any size take part, as queries and as candidates."""
    r = np.random.default_rng(8)
    rows = [(i, x) for i, x in enumerate((r.normal(size=(300, 8)) * 3).tolist())]
    rows += [(1000 + i, x) for i, x in enumerate((r.normal(size=(60, 8)) * 10.0 ** r.integers(3, 9, (60, 1))).tolist())]
    rows += [(50, rows[7][1]), (2000, [1e30] * 8), (2001, [-1e30, *[1e12] * 7]), (2050, [1e300] * 8), (2051, [1e300, *[1.0] * 7]), (2100, [40000.0] * 8), (2101, [40000.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in top_k(df, df.filter("vec_id % 50 = 0")).collect()]
    assert sorted(got) == top(rows, lambda i: i % 50 == 0)


def test_top_k_over_many_trees(spark, monkeypatch):
    """Trees and blocks of few vectors, summaries sent in turns, a hot direction that holds a third of all."""
    from lodestrata.llm import topk as K

    r = np.random.default_rng(9)
    v = r.normal(size=(900, 6))
    v[::3] = v[0] + r.normal(size=(300, 6)) * 0.01
    rows = list(enumerate(v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("TREE", 40), ("BLOCK", 7), ("LEAF", 8), ("SEED", 20), ("SUMMARY_BYTES", 600)):
        monkeypatch.setattr(K, name, value)
    got = [tuple(x) for x in top_k(df, df.filter("vec_id % 5 = 0"), k=3).collect()]
    assert sorted(got) == top(rows, lambda i: i % 5 == 0, 3)


# 9


def test_shards(spark):
    rows = some(8) + [(500, "x" * 3000)]
    got = shard_by_bytes(docs(spark, rows), 4).collect()
    keyed = sorted(((-(2**63) if i is None else i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, before, slots, want = sum(k[2] for k in keyed), 0, {}, []
    for i, crc, size in keyed:
        s = before * 4 // total
        want.append((i, crc, size, s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        before += size
    assert sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.text_crc32, r.size, r.shard, r.slot) for r in got) == sorted(want)
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    assert shard_by_bytes(docs(spark, [])).count() == 0


# 10


def test_archives_round_trip(spark):
    big, rows = "<p>" + "é" * 200, []
    rows = [(3, "u3", big), (1, "u1", big), (2, None, None), (5, "u5\r\nX: y", "short"), (6, "u6", "short"), (None, "n", big), (1, "again", big), (9, "u9", "\r\n\r\nWARC/1.1\r\n" + "z" * 200)]
    df = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, digest string")
    got = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in archive_and_read(df).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == big and i != 1
        want.append((-1 if i is None else i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else -1))
    assert got == sorted(want)
    assert archive_and_read(df.limit(0)).count() == 0


def read_all(data, step=37):
    at = 0

    def more(n):
        nonlocal at
        out = data[at : at + min(n, step)]
        at += len(out)
        return out

    return list(SalvageReader(more))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    recs = [record("response", f"{i:032x}", f"payload {i} ".encode() * 20, {"WARC-Payload-Digest": "sha256:" + hashlib.sha256(f"payload {i} ".encode() * 20).hexdigest()}) for i in range(5)]
    parts = [gzip_member(r) if packed else r for r in recs]
    whole = read_all(b"".join(parts))
    assert [type(x) for x in whole] == [Record] * 5 and whole[-1].end == sum(map(len, parts))
    hurt = list(parts)
    hurt[1] = hurt[1][:-40] + bytes(b ^ 255 for b in hurt[1][-40:-20]) + hurt[1][-20:]
    got = read_all(b"junk" + b"".join(hurt[:3]) + GZIP + b"??" + b"".join(hurt[3:]) + parts[0][:50])
    assert [x.payload[:9] for x in got if isinstance(x, Record)] == [b"payload 0", b"payload 2", b"payload 3", b"payload 4"]
    gaps = [x for x in got if isinstance(x, Gap)]
    edges = np.cumsum([4, *map(len, hurt[:3])])
    assert [(g.start, g.end) for g in gaps] == [(0, 4), (edges[1], edges[2]), (edges[3], edges[3] + 5), (edges[3] + 5 + sum(map(len, hurt[3:])), edges[3] + 5 + sum(map(len, hurt[3:])) + 50)]
    assert all(g.reason for g in gaps) and read_all(b"") == [] and [type(x) for x in read_all(b"nothing at all")] == [Gap]


def test_types_of_contract(spark, sf):
    from lodestrata.llm.queries import QUERIES

    kinds = {"op9_sharding": {"size": "bigint", "shard": "int", "slot": "bigint", "text_crc32": "bigint", "grown_shard": "int"}, "op5_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}}
    for name, want in kinds.items():
        assert {k: v for k, v in QUERIES[name](spark, sf).dtypes if k in want} == want
    assert isinstance(QUERIES["op1_suffix_array_dedup"](spark, sf).schema["n_spans"].dataType, T.LongType) and F


def test_hot_shards_are_searched_by_broadcast_trees(spark, monkeypatch):
    """A third of all fingerprints share two blocks of bits; trees of few members, sent in several turns."""
    from lodestrata.llm import simhash as S

    monkeypatch.setattr(S, "HOT", 16)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 6000)
    r = random.Random(14)
    fps = {r.getrandbits(32) | 0xABCD1234 << 32 for _ in range(100)} | {r.getrandbits(64) for _ in range(150)}
    fps |= {f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for f in list(fps)[:120]} | {0xABCD1234 << 32 | 1 << i for i in range(32)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f.to_bytes(8, "big"), []) for i, f in enumerate(fps)], "rep long, fp binary, keys array<long>")
    got = {x.node: x.component for x in components(S.links(nodes, 2)).collect()}
    best = np.arange(len(fps))
    near = np.array([[(a ^ b).bit_count() <= 2 for b in fps] for a in fps])
    for _ in range(60):
        best = np.where(near, best[None, :], len(fps)).min(1)
    assert [got.get(i, i) for i in range(len(fps))] == best.tolist() and len(got) > 100


def test_damaged_archives_are_logged_and_checked(spark, tmp_path):
    from lodestrata.llm import warc

    pages = spark.createDataFrame([(i, f"u{i}", f"<p>page {i % 7} " + "x" * (200 + 3000 * (i % 2)), i) for i in range(40)], "page_id long, url string, html string, date long")
    folder = f"file://{tmp_path}/archives"
    before = {r.page_id: r for r in warc.archive_and_read(pages, folder=folder, date="date").collect()}
    assert len(before) == 40 and sum(r.record_type == "revisit" for r in before.values()) == 26
    files = sorted((tmp_path / "archives").glob("*.warc.gz"))
    paths = spark.createDataFrame([(f"file://{f}",) for f in files], "path string")
    records = [r.headers for r in warc.read_archives(paths).filter("gap IS NULL").collect()]
    ids = {h["warc-record-id"] for h in records}
    assert len(ids) == 40 and all(h["warc-refers-to"] in ids for h in records if h["warc-type"] == "revisit")
    assert {h["warc-date"] for h in records} == {f"1970-01-01T00:00:{i:02d}Z" for i in range(40)}
    hurt = files[0].read_bytes()
    files[0].write_bytes(hurt[:30] + b"\0" * 20 + hurt[50:])
    got = warc.read_archives(paths).collect()
    gaps = [r for r in got if r.gap]
    log = (tmp_path / "archives" / (files[0].name + ".gaps.jsonl")).read_text().splitlines()
    assert len(gaps) == len(log) == 1 and len(got) - 1 == 39 and gaps[0].start == 0
    files[1].write_bytes(b"")
    with pytest.raises(Exception, match="records of"):
        warc.read_archives(paths.limit(0).union(spark.createDataFrame([(f"file://{files[1]}",)], "path string")).withColumn("records", F.lit(3))).collect()


def test_payload_join_without_broadcast(spark, monkeypatch):
    from lodestrata.llm import warc

    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    test_archives_round_trip(spark)


def hot_rows():
    """A third of all rows are copies, one word is in nearly all, one text is very long, some rows repeat, some are null or empty."""
    r = random.Random(31)
    rows = [(i, "the " + " ".join(r.choice("red green blue grey of the".split()) for _ in range(r.randint(1, 40)))) for i in range(120)]
    rows += [(200 + i, "the same copied text of a few words that very many documents have in common") for i in range(70)]
    return rows + [(900, " ".join(r.choice("red green blue the".split()) for _ in range(60_000))), (901, None), (902, ""), (3, rows[3][1]), (None, rows[4][1])]


def test_contamination_with_hot_terms_and_long_texts(spark):
    rows = hot_rows()
    items = [(1, "the"), (2, "the same copied text of a few words that very many"), (3, " ".join(rows[-5][1].split()[40_000:40_015])), (4, "of the of the of the of the of the"), (5, "grey red")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 10).collect())
    assert got == brute_contamination(rows, items, 10)


def test_fingerprints_of_hot_and_long_texts(spark):
    rows = hot_rows()

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    fps = [fingerprint(t) for _, t in rows]
    best = [-(2**63) if i is None else i for i, _ in rows]
    for _ in range(20):
        best = [min(b for b, g in zip(best, fps) if (f ^ g).bit_count() <= 2) for f in fps]
    got = sorted((-(2**63) if x.doc_id is None else x.doc_id, x.fingerprint, -(2**63) if x.component_id is None else x.component_id) for x in near_duplicates(docs(spark, rows), 3, 2).collect())
    assert got == sorted((-(2**63) if i is None else i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, best))


def test_shards_and_archives_of_hot_and_long_texts(spark):
    rows = hot_rows()
    got = sorted((r.shard, r.slot, r.size) for r in shard_by_bytes(docs(spark, rows), 5).collect())
    total, before = sum(x[2] for x in got), 0
    assert len(got) == len(rows) and total == sum(len((t or "").encode()) + 1 for _, t in rows)
    for shard in range(5):
        assert [x[1] for x in got if x[0] == shard] == list(range(sum(x[0] == shard for x in got)))
    for shard, _, size in got:
        assert shard == before * 5 // total
        before += size
    pages = spark.createDataFrame([(i, "u", t, 1) for i, t in rows], "page_id long, url string, html string, first long")
    back = archive_and_read(pages, least=20).collect()
    assert len(back) == len(rows) and sum(x.record_type == "revisit" and x.refers_to == 200 for x in back) == 69
    assert max(x.payload_bytes for x in back) == len(rows[-5][1])


def test_sets_are_compared_in_bulk():
    """Components of links that sets confirm equal those of all pairs, where many sets are about as similar as is asked."""
    from lodestrata.llm.simhash import Similar, jaccard, majority

    r, sets = np.random.default_rng(5), []
    base = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
    for _ in range(150):
        k = int(r.integers(5, 70))
        sets.append(np.unique(np.concatenate([base[r.permutation(len(base))[k:]], r.integers(0, 2**63, k, dtype=np.uint64)])))
    sets.append(np.zeros(0, np.uint64))
    fps = np.array([majority(s, 16) for s in sets], np.uint8).view(">u8").astype(np.uint64)
    near = np.array([[np.bitwise_count(a ^ b).sum() <= 256 and jaccard(s, t) >= 0.8 for b, t in zip(fps, sets)] for a, s in zip(fps, sets)])
    label = np.arange(len(sets))
    for _ in range(60):
        label = np.where(near, label[None, :], len(sets)).min(1)
    hashes, ends = np.concatenate(sets), [0, *np.cumsum([len(s) for s in sets]).tolist()]
    for at_once in (1 << 22, 500):
        check = Similar(hashes, ends, 0.8)
        check.AT_ONCE = at_once
        assert (tree_links(fps, 256, check) == label).all() and 1 < len(set(label.tolist())) < len(sets)
