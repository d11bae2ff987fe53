import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import spans
from lodestrata.llm.anchors import word_hashes
from lodestrata.llm.substring_dedup import ReferenceBlock, parsed_buckets, substring_dedup
from lodestrata.llm.suffix_dedup import bucket_pointers, covered, refined_buckets, suffix_dedup

CLASH = "doc_id long, text string, h long, k long, crc long, found string, text_ string, ranges int, kept string"


def brute_bytes(rows, n):
    """By id; rows of one id are one document, told apart by nothing but offset."""
    starts = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            key = (-(2**63) if i is None else i, s)
            starts.setdefault(b[s : s + n], []).append(key)
    first = {w: min(v) for w, v in starts.items()}
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < (-(2**63) if i is None else i, s):
                gone[s : s + n] = [True] * n
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def brute_words(rows, n):
    first = {}
    for i, t in rows:
        w, k = (t or "").encode().split(), -(2**63) if i is None else i
        for s in range(len(w) - n + 1):
            first[tuple(w[s : s + n])] = min(k, first.get(tuple(w[s : s + n]), k))
    out = []
    for i, t in rows:
        w, k = (t or "").encode().split(), -(2**63) if i is None else i
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < k:
                gone[s : s + n] = [True] * n
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = ["ab", "cd", "ñé", "x", "the", "あい", "zz", "a\0b"]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) + str(r.randint(0, 9)) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 5))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, None), (101, ""), (None, passages[0] + passages[0]), (102, "a" * 400), (103, "a" * 130), (104, "xy" * 300), (5, rows[5][1]), (7, "other " + passages[1]), (105, "q" * 30)]
    rows += [(200 + i, "w v " * 100) for i in range(20)] + [(300, " ".join(passages) * 30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "f", "t", 4, "k") for i, t in rows], CLASH)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    for n in (100, 40):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(frame(spark, rows), n).collect())
        assert got == brute_bytes(rows, n)


@pytest.mark.parametrize("seed", [3, 4])
def test_words_equal_brute_force(spark, seed):
    rows = corpus(seed)
    for n in (13, 6):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, rows), n).collect())
        assert got == brute_words(rows, n)


def test_empty_table(spark):
    none = frame(spark, [])
    assert suffix_dedup(none).count() == 0 and substring_dedup(none).count() == 0


def test_carried_columns_and_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage + " end", "en"), (2, "start " + passage, "de"), (3, "alone  here", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept, r.lang) for r in substring_dedup(df, carry=("lang",)).collect()}
    assert got == {1: (passage + " end", "en"), 2: ("start", "de"), 3: ("alone  here", None)}


@pytest.mark.parametrize("depth", [5, 8, 13, 100])
def test_refinement_sorts_suffixes(depth):
    r = np.random.default_rng(0)
    text = np.concatenate([r.integers(97, 100, 400), np.full(150, 97), r.integers(97, 99, 300)]).astype(np.uint8)
    raw = bytes(text) + b"\0" * depth
    pointers = bucket_pointers(text, depth)
    suffixes = [raw[i : i + depth] for i in range(len(text))]
    first = {x: n for n, x in reversed(list(enumerate(sorted(suffixes), 1)))}
    assert pointers.tolist() == [first[x] for x in suffixes]


def bucket_rows(unit, n=600):
    """Contexts of one bucket: a common middle between different ends."""
    r = random.Random(9)
    size = unit.left + unit.window
    tokens = [[r.choice("abc") if j < 3 or j >= size - unit.gram - 2 else "x" for j in range(size)] for _ in range(n)]
    rows = [(" " if unit.words else "").join(x).encode() for x in tokens]
    columns = [np.ones(n, np.int64), np.arange(n), np.arange(n), (np.arange(n) % 5 + 50).astype(np.int32), np.full(n, unit.left, np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(rows, pa.binary())], ["h", "k", "tag", "pos", "before", "context"])


@pytest.mark.parametrize("unit", [spans.Unit(70, 32, False, False), spans.Unit(13, 5, True, True)])
def test_long_bucket_is_carried(monkeypatch, unit):
    """A bucket longer than a step gives the ranges that brute force gives."""
    from lodestrata.llm import common, suffix_dedup as module

    batch, seen, want = bucket_rows(unit), {}, []
    for k, pos, before, context in zip(*(batch.column(c).to_pylist() for c in ("k", "pos", "before", "context"))):
        x = context.split() if unit.words else context
        own = [(k, 0 if unit.words else pos - before + s) for s in range(unit.left + 1)]
        hits = [s for s in range(unit.left + 1) if seen.setdefault(tuple(x[s : s + unit.window]), own[s]) < own[s]]
        if hits:
            want.append((k, k, pos - before + hits[0], pos - before + hits[-1] + unit.window))
    covers = parsed_buckets(unit.window) if unit.words else refined_buckets(unit.window)
    for least in (10_000, 60):
        monkeypatch.setattr(module, "whole_groups", lambda b, key, _, least=least: common.whole_groups(b, key, least))
        cut = [batch.slice(i, 50) for i in range(0, batch.num_rows, 50)]
        got = sorted(x for b in covers(iter(cut)) for x in zip(*(c.to_pylist() for c in b.columns)))
        assert got == want and len(want) > 50


def test_hot_buckets_are_dealt_by_window(spark, monkeypatch):
    r = random.Random(11)
    line, rows = "this very common line stands in each of the documents of the corpus, and it is longer than a window of bytes is", []
    for i in range(150):
        rows.append((i, " ".join(r.choice("abcd") * r.randint(1, 3) for _ in range(20)) + " " + line + " " + " ".join(r.choice("xyz") * r.randint(1, 3) for _ in range(20))))
    monkeypatch.setattr(spans, "HOT", 7)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(frame(spark, rows), 100).collect())
    assert got == brute_bytes(rows, 100)
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup(frame(spark, rows), 13).collect())
    assert got == brute_words(rows, 13)


def test_windows_longer_than_a_byte_counts(spark):
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh ") for _ in range(420))
    rows = [(1, "start " + passage), (2, passage[:400] + "END"), (3, "x" + passage[60:370] + "y")]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(frame(spark, rows), 300).collect())
    assert got == brute_bytes(rows, 300) and got[1][2] == 400 and got[2][2] == 310


def test_words_are_compared_not_hashes(spark):
    """Two words that a polynomial hash modulo 2^64 can't tell apart, whatever its base."""
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    rows = [(1, " ".join(["u"] * 6 + [thue] + ["v"] * 6)), (2, " ".join(["u"] * 6 + [other] + ["v"] * 6)), (3, "z" * 40 + thue), (4, "z" * 40 + other)]
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup(frame(spark, rows), 13).collect()) == brute_words(rows, 13)
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(frame(spark, rows), 100).collect()) == brute_bytes(rows, 100)


def test_rows_of_one_id(spark):
    """Many rows without an id, each its own text; repeated rows; the least id there is."""
    r = random.Random(13)
    rows = [(None, f"{i} " + " ".join(str(r.randint(0, 9)) for _ in range(60))) for i in range(300)]
    rows += [(7, rows[0][1])] * 40 + [(-(2**63), rows[1][1]), (8, rows[1][1] + " " + rows[2][1])]
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup(frame(spark, rows), 13).collect()) == brute_words(rows, 13)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(frame(spark, rows), 100).collect()) == brute_bytes(rows, 100)


def test_greedy_factors_and_their_ends():
    block = ReferenceBlock(4)
    block.add(b"a b c d e")
    block.add(b"d e f g h")
    assert block.covered(b"z a b c d e f g h z") == (1, 9)  # one factor, and one that begins before its end
    assert block.covered(b"a b c z d e f") == (0, 0) and block.covered(b"x c d e f z") == (0, 0)
    assert block.covered(b"q d e f g") == (1, 5)


def test_words_hash_alike_everywhere():
    a, _ = word_hashes([b"one two", b"two\tone\x0bthree"])
    assert a[0] == a[3] and a[1] == a[2] and len(set(a.tolist())) == 3
    assert word_hashes([b"", b"  "])[0].size == 0


def test_covered_windows():
    text = np.frombuffer(b"xxABCDyyzzABCDyy", np.uint8)
    lo, hi = covered(text, np.array([8, 16]), np.arange(2), np.zeros(2, int), 5)
    assert (lo[0], hi[0]) == (0, 0) and (lo[1], hi[1]) == (2, 8)


@pytest.mark.parametrize("other_document", [False, True])
def test_windows_of_hot_buckets_over_many_batches(other_document):
    """Windows by digest, in batches that cut their buckets: all but the first of each are covered; known runs are passed on."""
    unit, r, table = spans.Unit(13, 5, True, other_document), random.Random(5), []
    for h in range(30):
        for _ in range(r.choice([1, 1, 3, 200])):
            table.append((h, r.randint(0, 60), r.randint(0, 3), r.choice([b"aaaa", b"bbbb"])))
    table.sort(key=lambda x: (x[0], x[1], x[2]))
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in table]), pa.array([x[1] for x in table]), pa.array([x[1] for x in table]), pa.array([x[2] for x in table], pa.int32()), pa.array([spans.WINDOW] * len(table), pa.int32()), pa.array([x[3] for x in table], pa.binary())], ["h", "k", "tag", "pos", "before", "context"])
    known = pa.RecordBatch.from_arrays([pa.array([99]), pa.array([7]), pa.array([8]), pa.array([20], pa.int32()), pa.array([30], pa.int32()), pa.array([None], pa.binary())], batch.schema.names)
    first, want = {}, [(7, 8, 20, 50)]
    for h, k, pos, digest in table:
        who, at = first.setdefault((h, digest), (k, pos))
        if k != who or not other_document and pos != at:
            want.append((k, k, pos, pos + 13))
    for size in (1000, 37, 1):
        cut = [*(batch.slice(i, size) for i in range(0, batch.num_rows, size)), known]
        got = [x for b in spans._covers_of(unit, parsed_buckets(13))(iter(cut)) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == sorted(want)
