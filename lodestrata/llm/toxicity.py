"""Toxicity by a weighted finite-state pattern grammar (operator 7)."""

from __future__ import annotations

import math
import re
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import checkpoint, small

# The closed classes of the grammar, in the corpus's four languages. Insults beyond the seed words are learned from the labels, as words and word beginnings.
INSULTS = (
    "idiot moron stupid loser scum trash clown worthless pathetic disgusting dumb imbecile fool garbage filth vermin pig jerk "
    "idiotin dumm dummkopf abschaum versager trottel drecksau wertlos erbärmlich "
    "imbécile stupide ordure crétin salaud minable pourriture "
    "idiota estúpido estúpida basura imbécil escoria patético inútil"
).split()
THREATS = (
    "kill hurt destroy beat burn shoot hang stab punch murder crush "
    "umbringen töten verprügeln erschießen erstechen vernichten verbrennen "
    "tuer frapper buter égorger détruire brûler poignarder "
    "matar golpear apuñalar destruir quemar disparar"
).split()
#: Whom a threat may be aimed at: behind the verb, or before it (object pronouns of the other three languages). Subjects are aimed at by insults only.
OBJECTS = "you your yours u ya them him her people euch dich vous toi ustedes vosotros ti".split()
BEFORE = "dich euch ihn sie te t'ai vous toi os".split()
SUBJECTS = "youre you're they he she du ihr er tu il elle ils eres él ella ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't nobody none neither nor without nicht kein keine keiner nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna sin".split()
REPORTS = (
    "said says say told wrote writes claimed claims reported reports called quoted quote according alleged "
    "sagte sagt gesagt schrieb behauptete angeblich berichtete zitierte dit écrit déclaré affirme selon aurait dijo dice escribió afirmó según citó"
).split()

#: Token classes: other, insult, threat, object, object before its verb, both, subject, negation, report, clause end.
O, I, T, U, P, B, S, N, R, E = range(10)
CLASSES = 10
#: Clause kinds the grammar tells apart; the arcs that end one carry its weight, one each for the first, second and third of the kind in a text.
KINDS = ["insult", "insult at target", "threat at target", "negated", "reported", "bare threat"]
NTH = 3
#: Tokens that may lie between a threat and its target, either way.
NEAR = 2
#: Ends a stem that is a whole word; no token has it.
WHOLE = "$"
#: Labelled rows that stems and weights are fitted on, at most, and bytes of their texts: the ones with the least hash of the id.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 64 << 20


class Transducer:
    """A weighted finite-state transducer: arcs (state, symbol) -> (state, output, weight); a missing arc stays, copies and weighs nothing."""

    def __init__(self, start: int, arcs: dict[tuple[int, int], tuple[int, int, float]]):
        self.start, self.arcs = start, arcs

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def compose(self, other: Transducer, symbols: int) -> Transducer:
        """Self's output is other's input; states are pairs, numbered as they are reached."""
        names, todo, arcs = {(self.start, other.start): 0}, [(self.start, other.start)], {}
        while todo:
            a, b = todo.pop()
            for x in range(symbols):
                a2, y, w = self.step(a, x)
                b2, z, v = other.step(b, y)
                if (a2, b2) not in names:
                    names[a2, b2] = len(names)
                    todo.append((a2, b2))
                arcs[names[a, b], x] = (names[a2, b2], z, w + v)
        return Transducer(0, arcs)


def marker(symbols: set[int], bit: int) -> Transducer:
    """Sets a bit on what follows one of the symbols in the clause. Symbols carry a mask of what the clause has had: target 1, negation 2, report 4, aimed threat 8."""
    arcs = {}
    for mask in range(16):
        for x in range(CLASSES):
            for state in (0, 1):
                after = 0 if x == E else 1 if x in symbols else state
                arcs[state, mask * CLASSES + x] = (after, (mask | bit if state else mask) * CLASSES + x, 0.0)
    return Transducer(0, arcs)


def threats() -> Transducer:
    """Sets bit 8 on a threat with an object up to NEAR tokens before it, and on an object up to NEAR tokens behind one, which so becomes the threat."""
    arcs = {}
    # states: nothing; an object was so many tokens ago; a threat that is neither negated nor reported was
    idle, objects, waits = 0, range(1, NEAR + 2), range(NEAR + 2, 2 * NEAR + 3)
    for mask in range(8):
        for x in range(CLASSES):
            code, aimed = mask * CLASSES + x, (mask | 8) * CLASSES + T
            for state in (idle, *objects, *waits):
                last = idle if state in (objects[-1], waits[-1], idle) else state + 1
                if x == E:
                    arcs[state, code] = (idle, code, 0.0)
                elif x == T and mask & 6:
                    arcs[state, code] = (idle, code, 0.0)
                elif x == T:
                    arcs[state, code] = (idle, aimed, 0.0) if state in objects else (waits[0], code, 0.0)
                elif x in (U, B) and state in waits:
                    arcs[state, code] = (idle, aimed, 0.0)
                else:
                    arcs[state, code] = (objects[0] if x in (P, B) else last, code, 0.0)
    return Transducer(0, arcs)


def clauses(weights: np.ndarray) -> Transducer:
    """Turns marked insults and threats into clause kinds (output: kind + 1, 0 for none); an arc weighs what the first of its kind in a text does."""
    arcs = {}
    for mask in range(16):
        for x in range(CLASSES):
            kind = 0
            if x in (I, T):
                kind = 4 if mask & 2 else 5 if mask & 4 else (2 if mask & 1 else 1) if x == I else 3 if mask & 8 else 6
            arcs[0, mask * CLASSES + x] = (0, kind, float(weights[kind - 1, 0]) if kind else 0.0)
    return Transducer(0, arcs)


def grammar(weights: np.ndarray) -> Transducer:
    """Target, negation, reported speech and threat transducers, composed with the one that tells clauses: insults by their marks, threats aimed or bare."""
    width = CLASSES * 16
    marks = marker({U, P, B, S}, 1).compose(marker({N}, 2), width).compose(marker({R}, 4), width)
    return marks.compose(threats(), width).compose(clauses(weights), width)


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")


class Lexicon:
    """Classes of tokens: closed word lists, and insult stems (word beginnings, or words with WHOLE); answers are memorised."""

    def __init__(self, stems: set[str]):
        self.stems = stems
        self.sizes = sorted({len(s) for s in stems})
        self.known: dict[str, int] = {}
        self.fixed: dict[str, int] = {}
        for kind, names in ((S, SUBJECTS), (U, OBJECTS), (P, BEFORE), (B, set(OBJECTS) & set(BEFORE)), (R, REPORTS), (N, NEGATIONS), (T, THREATS), (I, INSULTS)):
            self.fixed |= dict.fromkeys(names, kind)
        self.fixed |= dict.fromkeys(".!?;:\n", E)

    def of(self, token: str) -> int:
        if (got := self.known.get(token)) is not None:
            return got
        got = self.fixed.get(token.replace("’", "'"), O)
        if got == O and any((token + WHOLE)[:n] in self.stems for n in self.sizes):
            got = I
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[token] = got
        return got


class Scorer:
    """Follows the composed grammar over a text; weights: a row per kind, a column for each of the first NTH matches."""

    def __init__(self, stems: set[str], weights: np.ndarray | None = None):
        self.lexicon = Lexicon(stems)
        self.weights = np.zeros((len(KINDS), NTH)) if weights is None else weights
        machine = grammar(self.weights)
        self.table = {k: arc for k, arc in machine.arcs.items() if k[1] < CLASSES}

    def matches(self, text: str) -> tuple[list[int], float]:
        """How many clauses of each kind, and what the path's arcs weigh: a kind's arcs change to the second and third weight as it recurs, then to 0."""
        of, counts, total = self.lexicon.of, [0] * len(KINDS), 0.0
        codes = [of(t) for t in _TOKEN.findall(text.lower())]
        if I in codes or T in codes:
            state, table = 0, self.table
            for c in codes:
                state, kind, weight = table[state, c]
                if kind:
                    n = counts[kind - 1]
                    total += weight if not n else float(self.weights[kind - 1, n]) if n < NTH else 0.0
                    counts[kind - 1] = n + 1
        return counts, total

    def arcs(self, text: str) -> np.ndarray:
        """Which weighted arcs the text's path takes: the design row that weights are learned from."""
        return (np.array(self.matches(text)[0])[:, None] > np.arange(NTH)).astype(float).ravel()


def words_of(text: str) -> set[str]:
    return {w for w in _TOKEN.findall(text.lower()) if w[0].isalpha()}


def beginnings(words: dict[str, set[int]]) -> Counter:
    """In how many texts each word, marked whole, and each beginning occurs; of beginnings of the same words only the longest.

    These are the nodes of the words' radix tree: at most two for a word and one for a branching, whatever the lengths. Consumes `words`.
    """
    counts: Counter = Counter()
    path: list[tuple[int, str, set[int]]] = []  # depth, a word through the node, its texts
    for name in [*sorted(w + WHOLE for w in words), ""]:
        shared = len(commonprefix((path[-1][1], name))) if path else 0
        while path and path[-1][0] > shared:
            depth, own, texts = path.pop()
            counts[own[:depth]] = len(texts)
            if depth == len(own):
                counts[own[:-1]] = len(texts)  # overwritten where other words begin so
            if path and path[-1][0] >= shared:
                few, many = sorted((path[-1][2], texts), key=len)
                many |= few
                path[-1] = (*path[-1][:2], many)
            elif shared:
                path.append((shared, own, texts))
        if name:
            path.append((len(name), name, words[name[:-1]]))
    return counts


def by_chance(hits: int, of: int, share: float) -> float:
    """How likely at least so many hits are if each has this share's chance."""
    log = lambda k: math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(share) + (of - k) * math.log1p(-share)
    return sum(math.exp(log(k)) for k in range(hits, of + 1))


def learn_stems(texts: list[str], labels: list[int], precision: float = 0.97) -> set[str]:
    """Words and word beginnings of any length that set toxic texts without seed insults apart: the commonest first, of equally common ones the longest beginning.

    A stem has to occur in them so often, and in clean texts so seldom, that chance would hardly (0.05 over all candidates) bring it about.
    """
    seeds, toxic, found = set(INSULTS), 0, {}
    for i, (t, y) in enumerate(zip(texts, labels)):
        if y and not seeds & (words := words_of(t)):
            toxic += 1
            for w in words:
                found.setdefault(w, set()).add(i)
    n_clean = sum(1 for y in labels if not y)
    if not found or not n_clean:
        return set()
    base, counts = toxic / (toxic + n_clean), beginnings(found)
    least = max(4, math.ceil(math.log(0.05 / len(counts)) / math.log(base)))
    often = {s: c for s, c in counts.items() if c >= least}
    sizes, clean, known = sorted({len(s) for s in often}), Counter(), {}
    for t, y in zip(texts, labels):
        if not y:
            words = words_of(t)
            for w in words:
                if w not in known:
                    known[w] = [s for n in sizes if n <= len(w) + 1 and (s := (w + WHOLE)[:n]) in often]
            clean.update({s for w in words for s in known[w]})
    good = [(-c, s.endswith(WHOLE), -len(s), s) for s, c in often.items() if c >= precision * (c + clean[s]) and by_chance(c, c + clean[s], base) * len(counts) <= 0.05]
    chosen: set[str] = set()
    for *_, s in sorted(good):
        if not any(s.startswith(x) or x.startswith(s) for x in chosen):
            chosen.add(s)
    return chosen


#: What arcs weigh before any label is seen: insults and aimed threats much, what is negated, reported or aimed at nobody little; recurrences less.
PRIOR = np.outer([2.5, 3.0, 3.0, 0.2, 0.2, 0.3], [1.0, 0.5, 0.25])


def fit(rows: list[tuple[str, int]]) -> dict:
    """Stems, and the weights of the grammar's arcs as a logistic model of labelled texts; arcs that no labelled text takes keep their prior."""
    texts, labels = [t for t, _ in rows], [int(y) for _, y in rows]
    stems = learn_stems(texts, labels)
    if not rows or len(set(labels)) < 2:
        base = (sum(labels) + 0.5) / (len(labels) + 1)
        return {"stems": sorted(stems), "w": (2 * PRIOR).tolist(), "b": math.log(base / (1 - base)) if rows else -4.0}
    scorer = Scorer(stems)
    x, y = np.array([scorer.arcs(t) for t in texts]), np.array(labels, float)
    design = np.hstack([x, np.ones((len(x), 1))])
    prior, keep = np.append(PRIOR.ravel(), 0.0), np.append(np.ones(x.shape[1]), 0.0)
    theta = np.zeros(design.shape[1])
    for _ in range(30):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (p - y) + keep * (theta - prior)
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(keep + 1e-6)
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"stems": sorted(stems), "w": theta[:-1].reshape(len(KINDS), NTH).tolist(), "b": float(theta[-1])}


def training_rows(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id", most: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> list:
    """(id, text, label) of at most `most` labelled ids whose crc32 mod 4 isn't 2, those with the least hash, while their texts have `size` bytes at most.

    Of several labels of an id the highest counts, of several texts the one with the least hash. What reaches the driver is bounded by `most` and `size`.
    """
    own, key = F.col(doc_id).cast("string").cast("binary"), F.xxhash64(F.col("id").cast("string"))
    ids = labels.select(F.col(doc_id).alias("id"), own.alias("own"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(F.pmod(F.crc32("own"), F.lit(4)) != 2)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).join(texts.select("id"), "id", "left_semi").orderBy(key, "id").limit(most)
    ids = checkpoint(ids)  # `most` rows
    found = texts.join(F.broadcast(ids), "id").withColumn("h", F.xxhash64("t"))
    sizes = found.groupBy("id").agg(F.min_by(F.octet_length("t"), "h").alias("n"), F.min("h").alias("h")).withColumn("at", key)
    chosen, total = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r["at"], r["id"])):
        total += r["n"]
        if total > size:
            break
        chosen.append((r["id"], r["h"]))
    if not chosen:
        return []
    kept = docs.sparkSession.createDataFrame(chosen, ids.select("id").schema.add("h", "long"))
    rows = found.join(F.broadcast(kept), ["id", "h"]).dropDuplicates(["id"])
    return sorted((r["id"], r["t"], r["y"]) for r in rows.select("id", "t", "y").collect())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", score: str = "toxicity") -> DataFrame:
    """docs with a column `score` from 0 to 1 added, which docs mustn't have."""

    def run(batches):
        scorer, b = Scorer(set(model["stems"]), np.array(model["w"])), model["b"]
        for batch in small(batches):
            z = [scorer.matches(t or "")[1] + b for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))), pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Score whole texts by the clauses that the grammar matches; stems (words and word beginnings of any length) and weights are learned from `labels` (doc_id, toxic).

    Tokens get a class (insult, threat, object, subject, negation, report, clause end); composed transducers follow them and tell an insult or
    threat by its clause: aimed at a target, bare, negated, or reported; a threat is aimed only at an object near it. A text's score is what the arcs of its path
    weigh, learned as a logistic model. Training uses at most TRAIN_ROWS rows of TRAIN_BYTES, none with crc32(id) mod 4 = 2. Without labels a prior scores. Null texts are empty; null ids are kept (not held out);
    repeated rows are scored each; an empty table gives none; other columns are ignored.

    Returns doc_id, held_out, score, predicted (1 if score >= threshold).
    """
    model = fit([(t, y) for _, t, y in training_rows(docs, labels, "toxic", text, doc_id)])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_"))
    scored = score_toxicity(rows, model, "text_")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
