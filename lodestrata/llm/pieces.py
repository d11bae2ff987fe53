"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding (operator 8)."""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import as_bytes, small

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Texts of a batch, and chunks (of whole texts) from which on they are segmented together.
TOGETHER, CHUNKS = 250, 50_000
_MASK, NEVER = 2**64 - 1, 2**40


@dataclass(frozen=True)
class Vocabulary:
    """Ids and merge ranks of the pieces, each id's bytes as decoded, and all pairs of ids that merge: key left * size + right, rank, id."""

    ids: dict[str, int]
    ranks: dict[str, int]
    bytes_: list[int]
    decoded: list[bytes]
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read on the driver; broadcast to the workers (a piece table is bounded: some MB)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, ranks, decoded, raw = {}, {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                raw[int(piece[3:-1], 16)] = i
                decoded.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                decoded.append(b"")
            else:
                ids[piece] = i
                decoded.append(piece.replace(SPACE, " ").encode())
                if len(piece) > 1:
                    ranks[piece] = int(-model.get_score(i))
        found = [(ids[p[:i]] * len(decoded) + ids[p[i:]], r, ids[p]) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        keys, order, new = (np.array(x, np.int64) for x in zip(*sorted(found)))
        return Vocabulary(ids, ranks, raw, decoded, (keys, order, new))


class _Pairs:
    """An open-addressing table over Vocabulary.pairs that looks up arrays of keys."""

    BITS = 20

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]):
        keys, self.rank, self.new = pairs
        self.slots, self.at = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int32)
        left, place = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[place[left]] < 0
            chosen, first = np.unique(place[left[free]], return_index=True)
            rows = left[free][first]
            self.slots[chosen], self.at[chosen] = keys[rows], rows
            left = np.setdiff1d(left, rows)
            place[left] = (place[left] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the pairs, -1 for none."""
        out, todo, place = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            there = self.slots[place[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.at[place[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            place[todo] = (place[todo] + 1) & ((1 << self.BITS) - 1)
        return out


class Encoder:
    """Byte-pair merges by an agenda: the best-ranked neighbouring pair first.

    With dropout p a candidate taken from the agenda is skipped, once and for all, if the keyed hash of its chunk, place and rank falls in
    the lowest p of its range.  The key is the seed, the variant (a hash of the document's id) and where the chunk stands in the text: each
    occurrence of a word is cut anew, yet a document always gets the same pieces, and another seed gives others.
    A chunk is a run of spaces with what follows up to the next space or line end: no piece reaches beyond one.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.0, seed: int = 0):
        self.v, self.limit, self.seed = vocabulary, int(dropout * 2**24), seed
        lines = any("\n" in p for p in vocabulary.ranks)
        self.chunks = re.compile(r" *[^ ]+| +" if lines else r" *[^ \n]+|\n| +")
        self.pairs = _Pairs(vocabulary.pairs)
        self.letters = np.full(0x110000, -2, np.int32)
        for piece, i in vocabulary.ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.letters[ord(piece)] = i
        self.letters[ord(" ")] = vocabulary.ids.get(SPACE, -2)

    def _seed(self, variant: int, place: int) -> int:
        return (self.seed * 0x9E3779B1 + variant + place * 0xD1B54A32D192ED03) & _MASK

    def segment(self, chunk: str, variant: int, place: int = 0) -> list[int]:
        """Ids of the chunk at a place (counted in chunks), its spaces as such."""
        ids, ranks, raw = self.v.ids, self.v.ranks, self.v.bytes_
        # A literal U+2581 isn't a space: it stays outside the merges and becomes bytes.
        parts = ["\0" if c == SPACE else SPACE if c == " " else c for c in chunk] if SPACE in chunk else list(chunk.replace(" ", SPACE))
        n = len(parts)
        if n > 1:
            limit = self.limit
            key = xxhash.xxh64_intdigest(chunk, self._seed(variant, place)) if limit else 0
            agenda = [(r, i, i + 1, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                r, i, j, both = heapq.heappop(agenda)
                if after[i] != j or parts[i] is None or parts[j] is None or parts[i] + parts[j] != both:
                    continue
                if limit and ((((key ^ (r * 0x9E3779B97F4A7C15 + i)) * 0xD6E8FEB86659FD93) & _MASK) >> 40) < limit:
                    continue
                parts[i], parts[j] = both, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := ranks.get(x := both + parts[k])) is not None:
                        heapq.heappush(agenda, (r, i, k, x))
                h = before[i]
                if h >= 0 and (r := ranks.get(x := parts[h] + both)) is not None:
                    heapq.heappush(agenda, (r, h, i, x))
        out = []
        # "\0" stands for a literal U+2581 only in chunks that hold one; there a real NUL is told apart by place.
        literal = iter(c for c in chunk if c in (SPACE, "\0")) if SPACE in chunk else None
        for p in parts:
            if p is None:
                continue
            if p == "\0" and literal is not None:
                p = next(literal)
            elif p in ids:
                out.append(ids[p])
                continue
            out += [raw[b] for b in p.encode()]
        return out

    def _ranked(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of neighbouring ids; no rank where they don't merge or the keyed hash skips them."""
        at = self.pairs.find(np.where((left >= 0) & (right >= 0), left.astype(np.int64) * len(self.v.decoded) + right, np.int64(2**62)))
        rank, new = np.where(at >= 0, self.pairs.rank[at], NEVER), self.pairs.new[at]
        if self.limit:
            with np.errstate(over="ignore"):
                h = ((key ^ (rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
            rank = np.where(h < self.limit, NEVER, rank)
        return rank, new

    def segment_all(self, chunks: list[str], variants: int | list[int], places: list[int] | None = None) -> list[bytes]:
        """segment() of many chunks at once, of one variant or a variant each: their agendas advance together, a merge each in every step."""
        variants = [variants] * len(chunks) if isinstance(variants, int) else variants
        places = places or [0] * len(chunks)
        out: list[bytes] = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, starts = self.letters[codes], np.concatenate([[0], np.cumsum(sizes)])
        strange = np.add.reduceat(np.append(ids < 0, False), starts[:-1]) if len(chunks) else np.zeros(0)
        for width in (4, 8, 12, 16, 24):
            own = np.flatnonzero((sizes <= width) & (sizes > {4: 0, 8: 4, 12: 8, 16: 12, 24: 16}[width]) & (strange == 0))
            for s in range(0, len(own), 8192):
                rows = own[s : s + 8192]
                for i, x in zip(rows.tolist(), self._merged(ids, starts[rows], sizes[rows], width, [(chunks[i], variants[i], places[i]) for i in rows.tolist()])):
                    out[i] = x
        for i in np.flatnonzero((sizes > 24) | (strange > 0)).tolist():
            out[i] = np.array(self.segment(chunks[i], variants[i], places[i]), np.int32).tobytes()
        return out

    def _merged(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, chunks: list[tuple[str, int, int]]) -> list[bytes]:
        m, column = len(starts), np.arange(width)
        inside = column < sizes[:, None]
        sym = np.where(inside, ids[np.minimum(starts[:, None] + column, len(ids) - 1)], -1).astype(np.int64)
        key = np.fromiter((xxhash.xxh64_intdigest(c, self._seed(v, p)) for c, v, p in chunks), np.uint64, m) if self.limit else np.zeros(m, np.uint64)
        after, before = np.tile(column + 1, (m, 1)), np.tile(column - 1, (m, 1))
        rank, new = np.full((m, width), NEVER), np.zeros((m, width), np.int64)
        r, c = np.nonzero(column < sizes[:, None] - 1)
        rank[r, c], new[r, c] = self._ranked(sym[r, c], sym[r, c + 1], key[r], c)
        rows = np.arange(m)
        while True:
            j = rank[rows].argmin(1)
            some = rank[rows, j] < NEVER
            rows, j = rows[some], j[some]
            if not len(rows):
                break
            k = after[rows, j]
            sym[rows, j], sym[rows, k] = new[rows, j], -1
            rank[rows, j] = rank[rows, k] = NEVER
            n = after[rows, j] = after[rows, k]
            right = np.flatnonzero(n < sizes[rows])
            before[rows[right], n[right]] = j[right]
            h = before[rows, j]
            left = np.flatnonzero(h >= 0)
            r = np.concatenate([rows[right], rows[left]])
            a, b = np.concatenate([j[right], h[left]]), np.concatenate([n[right], j[left]])
            rank[r, a], new[r, a] = self._ranked(sym[r, a], sym[r, b], key[r], a)
        alive = sym >= 0
        flat, ends = sym[alive].astype(np.int32).tobytes(), (np.cumsum(alive.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str], variants: list[int]) -> list[np.ndarray]:
        """Ids of each text; none for an empty one."""
        out: list[np.ndarray] = []
        chunks, owners, places, ends = [], [], [], [0]
        for i, (t, v) in enumerate(zip(texts, variants), 1):
            cut = self.chunks.findall(" " + t) if t else []
            chunks += cut
            owners += [v] * len(cut)
            places += range(len(cut))
            ends.append(len(chunks))
            if len(chunks) >= CHUNKS or i == len(texts):
                got = self.segment_all(chunks, owners, places)
                out += [np.frombuffer(b"".join(got[a:b]), np.int32) for a, b in zip(ends, ends[1:])]
                chunks, owners, places, ends = [], [], [], [0]
        return out

    def encode(self, text: str, variant: int = 0) -> np.ndarray:
        return self.encode_all([text], [variant])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.v.decoded
        return b"".join([table[i] for i in ids.tolist()])[1:]


def encode_documents(docs: DataFrame, dropout: float = 0.1, seed: int = 0, model: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with a column `tokens` (array of ids) added, see tokenize(); tokens that don't decode to their text raise."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        encoder = Encoder(shared.value, dropout, seed)
        for batch in small(batches, TOGETHER):
            texts, names = as_bytes(batch.column(text)), batch.column(doc_id).to_pylist()
            ids = encoder.encode_all([t.decode() for t in texts], [_variant(i, seed) for i in names])
            for name, t, x in zip(names, texts, ids):
                if encoder.decode(x) != t:
                    raise ValueError(f"the tokens of document {name} don't decode to its text")
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, "tokens"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("tokens", ArrayType(IntegerType())))


def _variant(doc_id, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id), seed)


def tokenize(docs: DataFrame, dropout: float = 0.1, seed: int = 0, model: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode whole texts with merge-dropout, decode them again and report both.

    Dropout is keyed by the id and by the place in the text, so the same word is cut differently from document to document and within one. Spaces, U+2581, bytes outside the vocabulary and line ends all survive decoding.
    Null and empty texts have no tokens; rows of one id are encoded each; an empty table gives none; other columns are ignored.

    Returns doc_id, variant (the low 31 bits of the id's hash), n_chars, n_tokens, n_byte_pieces (byte fallbacks), n_types (distinct pieces), tokens_sha256 (of the ids as
    little-endian int32), decoded_sha256, lossless.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        encoder = Encoder(shared.value, dropout, seed)
        fallback = np.zeros(len(shared.value.decoded), bool)
        fallback[shared.value.bytes_] = True
        for batch in small(batches, TOGETHER):
            rows, texts = [], as_bytes(batch.column("text_"))
            chosen, chars_of = [_variant(i, seed) for i in batch.column("doc_id").to_pylist()], [t.decode() for t in texts]
            for variant, chars, t, ids in zip(chosen, chars_of, texts, encoder.encode_all(chars_of, chosen)):
                back = encoder.decode(ids)
                rows.append((variant & 0x7FFFFFFF, len(chars), len(ids), int(fallback[ids].sum()), len(np.unique(ids)), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == t))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "variant", "n_chars", "n_tokens", "n_byte_pieces", "n_types", "tokens_sha256", "decoded_sha256", "lossless"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_"))
    return rows.mapInArrow(run, f"doc_id {kind}, variant int, n_chars long, n_tokens long, n_byte_pieces long, n_types long, tokens_sha256 string, decoded_sha256 string, lossless boolean")
