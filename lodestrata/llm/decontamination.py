"""Benchmark decontamination by a stored positional inverted index (operator 2), DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop_folder, work_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a table (checked) up to which it is broadcast; larger ones meet the postings in shuffled joins.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Words of a text, case kept; null has none."""
    found = F.split(F.coalesce(text, F.lit("")), BREAK)
    return F.filter(found, lambda w: w != "")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def benchmark_windows(items: DataFrame, window: int, text: str, item_id: str) -> DataFrame:
    """(win, item_id, terms): `window` consecutive words of an item, or all of a shorter one; win: the words joined, its identity."""
    w = items.select(F.col(item_id).alias("item_id"), F.transform(words(F.col(text)), ascii_lower).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    return w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("terms")).select("item_id", "terms", F.array_join("terms", " ").alias("win"))


def _bounded(df: DataFrame, size: Column) -> DataFrame:
    """df, marked for broadcast if its rows' sizes sum up to BROADCAST_BYTES at most."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def store_postings(base: DataFrame, vocabulary: DataFrame, folder: str) -> DataFrame:
    """The index: (tid, doc_id, th, pos) of every word of the corpus that is a test term, written once and read from there."""
    tokens = base.select("doc_id", "th", F.posexplode("w").alias("pos", "word"))
    # lower() folds more than A-Z: the comparison of the terms decides.
    found = tokens.join(_bounded(vocabulary, F.octet_length("term") + F.octet_length("low") + 32), F.lower("word") == F.col("low"))
    found.filter(ascii_lower(F.col("word")) == F.col("term")).select("tid", "doc_id", "th", "pos").write.option("compression", "zstd").parquet(folder)
    return base.sparkSession.read.parquet(folder)


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _of_rows(postings: DataFrame, some: DataFrame) -> DataFrame:
    """Postings of the rows (doc_id, th) that `some` has."""
    rows = some.select("doc_id", "th").distinct()
    return postings.alias("p").join(_bounded(rows, F.octet_length(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) + 32).alias("r"), _same_row("p", "r"), "left_semi")


def _phrases(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, th, wid, start, end): starts that the lists of all a window's terms imply, once their offsets are taken off."""
    first = _bounded(ranked.select("wid", F.size("by_count").alias("n"), F.col("by_count")[0]["offset"].alias("o1"), F.col("by_count")[0]["tid"].alias("t1"), F.get("by_count", F.lit(1))["offset"].alias("o2"), F.get("by_count", F.lit(1))["tid"].alias("t2")), F.lit(64))
    starts = postings.join(first, F.col("tid") == F.col("t1")).select("doc_id", "th", "wid", (F.col("pos") - F.col("o1")).alias("start"), "n", "o2", "t2").filter("start >= 0")
    starts = checkpoint(starts.distinct())  # repeated rows have one list
    # The second rarest list, only of terms that are second somewhere.
    seconds = postings.join(_bounded(ranked.select(F.get("by_count", F.lit(1))["tid"].alias("t")).filter("t IS NOT NULL").distinct(), F.lit(32)), F.col("tid") == F.col("t"), "left_semi")
    on = _same_row("s", "p") & (F.col("s.start") + F.col("s.o2") == F.col("p.pos")) & (F.col("s.t2") == F.col("p.tid"))
    two = checkpoint(starts.filter("n > 1").alias("s").join(seconds.alias("p"), on, "left_semi").select("doc_id", "th", "wid", "start", "n"))
    # What is left is mostly real: the lists of all further terms, of these rows only, each adjusted by its offset; a start has to be in every one.
    rest = ranked.select("wid", F.explode(F.slice("by_count", 3, F.greatest(F.size("by_count") - 2, F.lit(0)))).alias("x")).select("wid", "x.offset", "x.tid")
    wanted = two.filter("n > 2").join(_bounded(rest, F.lit(48)), "wid").select("doc_id", "th", "wid", "start", "n", (F.col("start") + F.col("offset")).alias("at"), "tid")
    lists = _of_rows(postings, two.filter("n > 2")).dropDuplicates(["tid", "doc_id", "th", "pos"])
    on = _same_row("s", "p") & (F.col("s.at") == F.col("p.pos")) & (F.col("s.tid") == F.col("p.tid"))
    met = wanted.alias("s").join(lists.alias("p"), on, "left_semi").groupBy("doc_id", "th", "wid", "start", "n").agg(F.count(F.lit(1)).alias("met"))
    found = reduce(DataFrame.unionByName, [x.select("doc_id", "th", "wid", "start", "n") for x in (starts.filter("n = 1"), two.filter("n = 2"), met.filter("met = n - 2"))])
    return found.select("doc_id", "th", "wid", "start", (F.col("start") + F.col("n")).alias("end"))


def _spans(postings: DataFrame, ranked: DataFrame, extra: int) -> DataFrame:
    """As _phrases(), with up to `extra` other words among a window's terms, which stand in order."""
    first = _bounded(ranked.select("wid", F.size("tids").alias("n"), F.col("by_count")[0]["offset"].alias("o1"), F.col("by_count")[0]["tid"].alias("t1"), F.get("by_count", F.lit(1))["tid"].alias("t2")), F.lit(64))
    near = postings.join(first, F.col("tid") == F.col("t1")).select("doc_id", "th", "wid", (F.col("pos") - F.col("o1") - extra).alias("begin"), "n", "t2").distinct()
    near = checkpoint(near.withColumn("stop", F.col("begin") + F.col("n") + 2 * extra))
    lists = _of_rows(postings, near).dropDuplicates(["tid", "doc_id", "th", "pos"])
    inside = (F.col("p.pos") >= F.col("s.begin")) & (F.col("p.pos") < F.col("s.stop"))
    two = near.alias("s").join(lists.alias("p"), _same_row("s", "p") & F.coalesce(F.col("s.t2") == F.col("p.tid"), F.lit(False)) & inside, "left_semi")
    two = checkpoint(two.unionByName(near.filter("t2 IS NULL")).drop("t2"))
    terms = ranked.select("wid", F.explode(F.array_distinct("tids")).alias("tid"))
    there = two.join(_bounded(terms, F.lit(32)), "wid").alias("s").join(lists.alias("p"), _same_row("s", "p") & (F.col("s.tid") == F.col("p.tid")) & inside)
    there = there.groupBy("s.doc_id", "s.th", "s.wid", "s.begin").agg(F.collect_set(F.struct("p.pos", "p.tid")).alias("list")).join(_bounded(ranked.select("wid", "tids"), F.lit(32) + 8 * F.size("tids")), "wid")
    # From each place of the first term, every next one where it comes first: the shortest span from there.
    heads = there.withColumn("head", F.explode(F.filter("list", lambda x: x["tid"] == F.col("tids")[0])["pos"]))
    # the lambda reads tids beside its own variables
    step = lambda at, t: F.array_min(F.transform(F.filter("list", lambda x: (x["tid"] == t) & (x["pos"] > at)), lambda x: x["pos"]))
    last = F.aggregate(F.slice("tids", 2, F.greatest(F.size("tids") - 1, F.lit(0))), F.col("head"), step)
    return heads.withColumn("end", last + 1).filter(F.col("end") - F.col("head") <= F.size("tids") + extra).select("doc_id", "th", "wid", F.col("head").alias("start"), "end").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", near: int | None = None) -> DataFrame:
    """Exact phrase matches of the items' word windows in documents.

    1. The corpus is tokenised into a positional index of the test terms: (term, document, position), written as Parquet in the shared folder.
    2. Counts of the lists rank each distinct window's terms by rarity.
    3. Lists are intersected from the rarest term on, offsets taken off: the rarest list gives starts, the second rarest leaves few of them,
       and a start that is left has to be in the lists of all further terms.
    4. Words inside any surviving phrase are hits.

    With near=k a window also matches where its terms stand, in order, with up to k other words among them in all (proximity): from the same lists.

    Words: A-Z lower-cased, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null texts have none; null ids are kept, one document per input row, repeated
    rows of an id share their union of hits; empty tables give no hits or no rows; other columns are ignored. Ids may have any type that compares.

    Returns for each input row: doc_id, n_words, n_hit, n_items, items_sha256 (sorted item ids, comma-joined), contaminated,
    spans (array of start, end in words).
    """
    spark = docs.sparkSession
    # A row's own key: repeated ids with other texts stay apart.
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), words(F.col(text)).alias("w"))
    wins = benchmark_windows(items, window, item_text, item_id).groupBy("win", "terms").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    wins = checkpoint(wins.withColumn("wid", F.monotonically_increasing_id()))
    terms = wins.select("wid", F.posexplode("terms").alias("offset", "term"))
    vocabulary = checkpoint(terms.select("term").distinct().withColumn("low", F.lower("term")).withColumn("tid", F.monotonically_increasing_id()))
    folder = work_folder(spark, "postings")
    postings = store_postings(base, vocabulary, folder)
    counts = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("count"))
    # A window with a term that has no list is in no document.
    placed = terms.join(vocabulary, "term").join(counts, "tid", "left").groupBy("wid").agg(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "tid")).alias("x"))
    in_order = F.transform(F.array_sort(F.transform("x", lambda y: F.struct(y["offset"].alias("offset"), y["tid"].alias("tid")))), lambda y: y["tid"])
    ranked = checkpoint(placed.filter(~F.exists("x", lambda y: y["count"] == 0)).select("wid", F.array_sort("x").alias("by_count"), in_order.alias("tids")))
    matched = _spans(postings, ranked, near) if near else _phrases(postings, ranked)
    matched = matched.join(_bounded(wins.select("wid", "items"), F.octet_length(F.array_join("items", ",")) + 32), "wid")
    found = matched.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # Hit words: sorted spans, each adding what lies beyond the ends before it.
    hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")), lambda a: a["n"])
    found = checkpoint(found.select("doc_id", "th", hit.alias("n_hit"), "items", F.array_sort("spans").alias("spans")))
    drop_folder(spark, folder)
    rows = base.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    small = _bounded(found, F.octet_length(F.array_join("items", ",")) + 8 * F.size("spans") + 64)
    both = rows.alias("r").join(small.alias("f"), _same_row("r", "f"), "left")
    n_hit = F.coalesce("f.n_hit", F.lit(0).cast("long"))
    n_items = F.greatest(F.coalesce(F.size("f.items"), F.lit(0)), F.lit(0)).cast("long")
    return both.select("r.doc_id", "r.n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce(F.array_join("f.items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "f.spans")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= n),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
