"""Cross-entropy difference (Moore and Lewis, 2010) with two matched bigram models.

Words are hashed into one closed vocabulary of 2^word_bits entries, which grows with the corpus;
bigrams are counted by both of their entries, exactly. The vocabulary is shared by the target and
the background model, whose order and smoothing are equal too, so a collision weighs the same in
either. Loss of a word:

    -ln( (1-MIX) (c(w)+ALPHA)/(N+ALPHA V) + MIX c(u,w)/c(u) )     (no second term if c(u) = 0)

c(u) being the count of the preceding word; a text starts with a boundary word. A document is
scored by models that have not seen it: its own words are taken off the background's counts, and
off the target's if it is a target document. Its score is its mean loss under the target model
less that under the background model: the lower, the more it reads like the target.

Counts are never gathered in one place. Documents are dealt into chunks by id; a chunk sends its
distinct keys with their counts to the slices of the key table, and a slice sends each chunk the
corpus-wide counts of the chunk's own keys. Chunks and slices are of fixed size, so that their
number grows with the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX, ALPHA = 0.7, 0.5
#: Of the vocabulary; two entries and the kind of a key fill 64 bits.
MIN_BITS, HASH_BITS = 14, 31
#: Characters of text for each chunk of documents and each slice of the key table.
CHUNK_CHARS, SLICE_CHARS = 16 << 20, 32 << 20
#: Tokens whose losses are worked out at a time.
BLOCK_TOKENS = 1 << 18
PARTS = "chunk long, slice long, keys binary, background binary, goal binary, n_background long, n_goal long, ids binary"
COUNTS = "chunk long, slice long, background binary, goal binary, n_background long, n_goal long, ids binary"
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double"


def word_ids(text: bytes | None) -> np.ndarray:
    """32-bit word hashes: CRC-32 of the lower-cased (A-Z) words parted by ASCII white space."""
    words = (text or b"").lower().split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def slots(ids: np.ndarray, word_bits: int, pair_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary entry of each word, of the word before it, and both as one number."""
    w = ((ids.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - word_bits)
    before = np.concatenate([[np.uint64(0)], w[:-1]])
    pair = before << np.uint64(pair_bits - word_bits) | w
    return w.astype(np.int64), before.astype(np.int64), pair.astype(np.int64)


def table_bits(chars: int) -> tuple[int, int]:
    """Bits of a vocabulary entry and of a pair. The vocabulary follows the corpus, one entry for
    about 256 characters, up to the width of the words' hashes."""
    word = min(HASH_BITS, max(MIN_BITS, math.ceil(math.log2(max(chars, 1) / 256))))
    return word, 2 * word


def pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


class Keys:
    """The distinct keys of some texts: pairs, then words, then preceding words, each in order.

    ``pairs``, ``words`` and ``befores`` are numbers of keys, ``token`` is the pair's key of each
    token, ``word`` and ``before`` the keys of each pair's entries, ``lengths`` words per text."""

    def __init__(self, texts: list[bytes | None], word_bits: int, pair_bits: int):
        ids = [*map(word_ids, texts)]
        self.lengths = np.array([len(x) for x in ids], dtype=np.int64)
        pair = np.concatenate([np.zeros(0, np.int64), *(slots(x, word_bits, pair_bits)[2] for x in ids if len(x))]).astype(np.uint64)
        pairs, self.token = np.unique(pair, return_inverse=True)
        words, word = np.unique(pairs & np.uint64((1 << word_bits) - 1), return_inverse=True)
        befores, before = np.unique(pairs >> np.uint64(word_bits), return_inverse=True)
        self.pairs = len(pairs)
        self.token = self.token.astype(np.int32)
        self.word, self.before = (word + len(pairs)).astype(np.int32), (before + len(pairs) + len(words)).astype(np.int32)
        self.keys = np.concatenate([pairs, words | np.uint64(1 << 62), befores | np.uint64(1 << 63)])

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """How often each key occurs among the given tokens (a mask)."""
        n = np.bincount(self.token[tokens], minlength=self.pairs)[: self.pairs]
        size = len(self.keys)
        return np.concatenate([n, np.zeros(size - self.pairs, np.int64)]) + sum(np.bincount(at, n, size).astype(np.int64) for at in (self.word, self.before))

    def slices(self, n: int) -> list[np.ndarray]:
        """Where the keys of each slice stand."""
        own = ((self.keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)
        order = np.argsort(own, kind="stable")
        return np.split(order, np.searchsorted(own[order], np.arange(1, n, dtype=np.uint64)))

    def blocks(self) -> Iterator[tuple[slice, slice]]:
        """Texts of BLOCK_TOKENS tokens together, or one text: (texts, their tokens)."""
        ends = np.cumsum(self.lengths)
        at = 0
        while at < len(ends):
            first = int(ends[at] - self.lengths[at])
            upto = max(at + 1, int(np.searchsorted(ends, first + BLOCK_TOKENS, "right")))
            yield slice(at, upto), slice(first, int(ends[upto - 1]))
            at = upto

    def losses(self, texts: slice, tokens: slice, models: list[tuple[np.ndarray, int, np.ndarray]], word_bits: int) -> list[np.ndarray]:
        """Loss of each of the tokens under each model (counts, total, which texts it has seen), less
        what its own text counts where the model has seen it."""
        token = self.token[tokens]
        lengths = self.lengths[texts]
        text = np.repeat(np.arange(len(lengths)), lengths)
        keys, own = (token, self.word[token], self.before[token]), []
        for key in keys:
            _, at, n = np.unique(text * (len(self.keys) + 1) + key, return_inverse=True, return_counts=True)
            own.append(n[at])
        out = []
        for counts, n, marked in models:
            seen = marked[texts][text]
            pair, word, before = (counts[key] - k * seen for key, k in zip(keys, own))
            single = (word + ALPHA) / (n - lengths[text] * seen + ALPHA * (1 << word_bits))
            both = np.where(before > 0, pair / np.maximum(before, 1), 0.0)
            out.append(-np.log((1 - MIX) * single + MIX * np.minimum(both, 1.0)))
        return out


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", target: str = "quality = 1") -> DataFrame:
    """``(doc_id, n_tokens, loss_target, loss_background, ce_diff)`` for each row of ``docs``.

    Background: all documents. Target: the documents that ``labels`` marks by the SQL condition
    ``target``. Both models' counts cover every token of every document but the one that is scored;
    a copy of it under another row counts. Losses are means per
    token; null and empty texts have 0 tokens and null losses. Labels without a document,
    repeated labels and null labels change nothing; without any target document the target model is
    uniform. An empty table gives no rows."""
    chars = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    word_bits, pair_bits = table_bits(chars)
    chunks, slices = chars // CHUNK_CHARS + 1, chars // SLICE_CHARS + 1
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).alias("chunk")
    # rows without an id match no label, and go by their text
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(chunk(F.coalesce("id", F.xxhash64("text"))), "id", "text")
    good = labels.where(target).where(F.col(label_id).isNotNull()).select(F.col(label_id).cast("long").alias("id")).distinct().select(chunk(F.col("id")), "id")
    texts = lambda t: t.column("text").cast(pa.binary()).to_pylist()

    def count(rows, marked):
        if not rows.num_rows:
            return pa.table({c: pa.array([], pa.binary() if c in ("keys", "background", "goal", "ids") else pa.int64()) for c in ("chunk", "slice", "keys", "background", "goal", "n_background", "n_goal", "ids")})
        k = Keys(texts(rows), word_bits, pair_bits)
        wanted = set(marked.column("id").to_pylist())
        mask = np.repeat(np.array([i in wanted for i in rows.column("id").to_pylist()], dtype=bool), k.lengths)
        background, goal = k.counts(np.ones(len(mask), dtype=bool)), k.counts(mask)
        parts = k.slices(slices)
        return pa.table(
            {
                "chunk": pa.array([rows.column("chunk")[0].as_py()] * slices, pa.int64()),
                "slice": pa.array(range(slices), pa.int64()),
                "keys": pa.array([pack(np.diff(k.keys[at], prepend=np.uint64(0))) for at in parts], pa.binary()),
                "background": pa.array([pack(background[at]) for at in parts], pa.binary()),
                "goal": pa.array([pack(goal[at]) for at in parts], pa.binary()),
                "n_background": pa.array([len(mask)] * slices, pa.int64()),
                "n_goal": pa.array([int(mask.sum())] * slices, pa.int64()),
                # the target's own ids, with the first slice
                "ids": pa.array([np.array(sorted(wanted), dtype="<i8").tobytes()] + [None] * (slices - 1), pa.binary()),
            }
        )

    def add(t):
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in t.column("keys").to_pylist()]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        out = {"chunk": t.column("chunk"), "slice": t.column("slice"), "ids": t.column("ids")}
        for c in ("background", "goal"):
            sums = np.bincount(at, np.concatenate([unpack(x) for x in t.column(c).to_pylist()]))
            out[c] = pa.array([pack(x) for x in np.split(sums[at], ends)], pa.binary())
        for c in ("n_background", "n_goal"):
            out[c] = pa.array([sum(t.column(c).to_pylist())] * t.num_rows, pa.int64())
        return pa.table(out).select([*(c for c in out if c != "ids"), "ids"])

    def score(rows, counts):
        k = Keys(texts(rows), word_bits, pair_bits)
        some = k.lengths > 0
        parts = k.slices(slices)
        wanted = {i for x in counts.column("ids").to_pylist() if x for i in np.frombuffer(x, dtype="<i8").tolist()}
        marked = np.array([i in wanted for i in rows.column("id").to_pylist()], dtype=np.int64)
        models = []
        for c, seen in (("goal", marked), ("background", np.ones(len(marked), dtype=np.int64))):
            n = np.zeros(len(k.keys), dtype=np.int64)
            for s, x in zip(counts.column("slice").to_pylist(), counts.column(c).to_pylist()):
                n[parts[s]] = unpack(x)
            models.append((n, counts.column(f"n_{c}")[0].as_py() if counts.num_rows else 0, seen))
        del parts
        means = {c: np.zeros(len(some)) for c in ("goal", "background")}
        for own, tokens in k.blocks():
            full = np.flatnonzero(some[own])
            if len(full):
                lengths = k.lengths[own]
                starts = (np.cumsum(lengths) - lengths)[full]
                for mean, loss in zip(means.values(), k.losses(own, tokens, models, word_bits)):
                    mean[own.start + full] = np.add.reduceat(loss, starts) / lengths[full]
        return pa.table(
            {
                "doc_id": rows.column("id"),
                "n_tokens": pa.array(k.lengths),
                "loss_target": pa.array(means["goal"], mask=~some),
                "loss_background": pa.array(means["background"], mask=~some),
            }
        )

    by_chunk = dealt.groupBy("chunk")
    parts = by_chunk.cogroup(good.groupBy("chunk")).applyInArrow(count, PARTS)
    sums = parts.groupBy("slice").applyInArrow(add, COUNTS)
    scored = by_chunk.cogroup(sums.groupBy("chunk")).applyInArrow(score, SCORES)
    return scored.withColumn("ce_diff", F.col("loss_target") - F.col("loss_background"))
