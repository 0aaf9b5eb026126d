"""Operator 7: Katz backoff language model with Good-Turing discounts.

A bigram model with unigram backoff over words and one end token per text; the first token's context is the start:

* counts r <= 5 are discounted by Good-Turing (d = (r*/r - q) / (1 - q) with r* = (r+1) n[r+1] / n[r] and
  q = 6 n[6] / n[1]); a count whose factor isn't between 0 and 1 isn't discounted, and where no count can be, half a
  count is taken off every count instead;
* unigram: d c(w) / N, and what the discounts free is the probability of the unknown token (any word not in training);
* bigram: d c(v,w) / c(v) if (v, w) is in training, else alpha(v) times the unigram probability, with
  alpha(v) = (1 - sum of d c(v,w) / c(v)) / (1 - sum of P(w)) over the words w seen after v, so that the probabilities
  after every context sum to exactly 1. A context in which nothing is discounted leaves 1 / (c(v) + 1) for the rest.
  After a context without training counts the unigram probability holds.

The corpus becomes a table of chunks: token numbers that are local to a chunk, and the 64-bit hashes and training counts of
its words. Word counts are summed by hash and brought back to the chunks. Each chunk sends its different bigrams, each once
with its number in training, to buckets by context; frequent contexts are spread over several buckets by their next word. So a
frequent bigram, or a text with many copies, is one row per chunk however often it occurs. A bucket sums the counts and
returns to each chunk the counts of its bigrams and, per context, how many bigrams have each low count and the backed-off
probability of the words seen: the tables of counts and of what the backoff weights are made from, partitioned by bucket.
Once the counts of counts are known, every token is scored in its chunk, by its bigram's count or else by the weight of its
context and the count of its word.

Only the counts of counts and one row per spread context (those with over a quarter of a bucket's tokens, so that their
number is at most four per bucket) come to the driver. Words and bigrams are told apart by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; a null doc_id is in training; rows with equal doc_id are scored
each by itself; without training texts the unknown token has probability 1; an empty table gives an empty table; only the
two named columns are read. Texts of any length are scored whole.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.shared import slices, stored, texts_of
from lexspark.llm.shingles import mix

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
GOOD_TURING = 5
KINDS = GOOD_TURING + 1  # bigrams of a context that are counted once, twice, ..., more often than is discounted
MOST_BUCKETS = 100_000  # Spark's own limit for a table
END, START = 0, np.uint64(0x517CC1B727220A95)  # the end token is number 0 of every chunk
_END_HASH = np.uint64(0x2127599BF4325C37)
_CHUNK = pa.schema([("chunk", pa.int64()), ("entries", pa.int64()), ("tokens", pa.int64()), ("trained", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()), ("stream", pa.binary())])
_PAYLOAD = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of the same place lie together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        out.append(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(x).to_bytes(8, "little") + x for x in out))


def unsqueezed(value: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        n, kind = int.from_bytes(data[at + 8 : at + 16], "little"), np.dtype(data[at + 16 : at + 20].decode().strip())
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at + 20)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 8 + size
    return out


def in_training(doc_id: int | None, folds: int = 7, held: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != held


def token_chunks(docs: DataFrame, most_tokens: int = 1_000_000) -> DataFrame:
    """The corpus as chunks of about ``most_tokens`` tokens.

    docs: doc_id, null mark, tokens and training mark of each text; words: hash and training count by local number;
    stream: local numbers of all tokens.
    """

    def chunks(batches):
        place = TaskContext.get().partitionId() << 24
        numbers: dict[bytes, int] = {}
        streams: list[list[int]] = []
        rows: list[tuple] = []

        def close():
            nonlocal place, numbers, streams, rows
            stream = np.array([x for s in streams for x in s], np.uint32)
            hashes = np.empty(len(numbers) + 1, np.uint64)
            hashes[END] = _END_HASH
            hashes[1:] = [xxhash.xxh3_64_intdigest(w) for w in numbers]
            doc_id, null, size, train = (np.array(x) for x in zip(*rows))
            trained = np.bincount(stream[np.repeat(train, size)], minlength=len(hashes)).astype(np.uint32)
            values = {"chunk": [place], "entries": [len(hashes)], "tokens": [len(stream)], "trained": [int(train.sum())],
                      "docs": [squeezed(doc_id.astype(np.int64), null, size.astype(np.uint32), train)], "words": [squeezed(hashes, trained)], "stream": [squeezed(stream)]}
            place, numbers, streams, rows = place + 1, {}, [], []
            return pa.RecordBatch.from_pydict(values, schema=_CHUNK)

        held = 0
        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                words = text.encode().lower().split()
                for w in set(words):
                    if w not in numbers:
                        numbers[w] = len(numbers) + 1
                streams.append([*map(numbers.__getitem__, words), END])
                rows.append((doc or 0, doc is None, len(words) + 1, in_training(doc)))
                held += len(words) + 1
                if held >= most_tokens:
                    yield close()
                    held = 0
        if rows:
            yield close()

    return docs.mapInArrow(chunks, "chunk long, entries long, tokens long, trained long, docs binary, words binary, stream binary")


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, GOOD_TURING + 2).astype(np.int64), minlength=GOOD_TURING + 3)[: GOOD_TURING + 2]


def groups(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, first, end) of the runs of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return list(zip(keys[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


def word_totals(chunks: DataFrame, parts: int) -> DataFrame:
    """For each chunk the training counts over the whole corpus: chunk, places, totals. Rows with chunk -1 hold the counts of
    counts, the tokens and the distinct words of one part of the vocabulary."""

    def deal(batches):
        for b in batches:
            for chunk, words in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist()):
                hashes, trained = unsqueezed(words)
                part = (mix(hashes) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable").astype(np.uint32)
                rows = [(p, chunk, squeezed(at := order[s:e], hashes[at], trained[at])) for p, s, e in groups(part[order])]
                yield pa.RecordBatch.from_pydict(dict(zip(("part", "chunk", "words"), zip(*rows))), schema=pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary())]))

    def total(rows):
        parts_ = [unsqueezed(x) for x in rows["words"]]
        _, place = np.unique(np.concatenate([p[1] for p in parts_]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([p[2] for p in parts_])).astype(np.int64)
        ends = np.cumsum([len(p[0]) for p in parts_])
        out = [(c, squeezed(p[0], sums[place[e - len(p[0]) : e]])) for c, p, e in zip(rows["chunk"], parts_, ends)]
        out.append((-1, squeezed(counts_of_counts(sums), np.array([sums.sum(), (sums > 0).sum()]))))
        return pd.DataFrame(out, columns=["chunk", "totals"])

    return chunks.select("chunk", "words").mapInArrow(deal, "part int, chunk long, words binary").groupBy("part").applyInPandas(total, "chunk long, totals binary")


class Discounts:
    """Discount factors of counts, from the counts of counts."""

    def __init__(self, n: np.ndarray):
        self.turing = np.ones(GOOD_TURING + 1)
        self.usable = False
        if n[1] > 0 and (q := (GOOD_TURING + 1) * n[GOOD_TURING + 1] / n[1]) < 1:
            r, here, above = np.arange(1, GOOD_TURING + 1), n[1 : GOOD_TURING + 1], n[2 : GOOD_TURING + 2]
            d = ((r + 1) * above / np.maximum(here, 1) / r - q) / (1 - q)
            self.turing[1:] = np.where((here > 0) & (d > 0) & (d <= 1), d, 1.0)
            self.usable = bool(((self.turing[1:] < 1) & (here > 0)).any())

    def of(self, counts: np.ndarray) -> np.ndarray:
        if self.usable:
            return np.where(counts <= GOOD_TURING, self.turing[np.minimum(counts, GOOD_TURING)], 1.0)
        return (counts - 0.5) / np.maximum(counts, 1)


class Unigrams:
    """P(w) by training count; what is freed belongs to the unknown token."""

    def __init__(self, n: np.ndarray, tokens: int, words: int, high: float):
        """``high``: tokens of words with counts over those discounted by Good-Turing."""
        self.discounts, self.tokens, self.words = Discounts(n), tokens, words
        r = np.arange(1, GOOD_TURING + 1)
        if not tokens:
            self.unknown = 1.0
        elif self.discounts.usable:
            self.unknown = 1.0 - float((self.discounts.turing[1:] * r * n[1 : GOOD_TURING + 1]).sum() + high) / tokens
        else:
            self.unknown = 0.5 * words / tokens

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) * counts / max(self.tokens, 1), self.unknown)


def backoff_weight(seen: np.ndarray, freed_from: np.ndarray) -> np.ndarray:
    """alpha(v) from the sums over seen words of the discounted and of the backed-off probabilities."""
    return (1.0 - seen) / np.maximum(1.0 - freed_from, 1e-300)


class ChunkBigrams:
    """A chunk with the counts of its words over the whole corpus, and its different bigrams in the order of their buckets."""

    def __init__(self, row: dict, buckets: int, spread_over: int, starts: int):
        self.doc_id, self.null, self.size, self.train = unsqueezed(row["docs"])
        hashes, _ = unsqueezed(row["words"])
        (self.stream,) = unsqueezed(row["stream"])
        totals = np.zeros(len(hashes) + 1, np.int64)
        for part in row["totals"]:
            at, sums = unsqueezed(part)
            totals[at] = sums
        # Contexts: the token before, and for first tokens the start, which gets the number after the words.
        totals[-1] = starts
        self.hashes, self.totals = np.append(hashes, START), totals
        self.first = np.cumsum(self.size.astype(np.int64)) - self.size
        context = np.empty(len(self.stream), np.int64)
        context[1:] = self.stream[:-1]
        context[self.first] = len(hashes)
        n = len(self.hashes)
        bigrams, place = np.unique(context * n + self.stream, return_inverse=True)
        context, word = bigrams // n, bigrams % n
        with np.errstate(over="ignore"):
            home = mix(self.hashes)[context]
            ways = (totals[context] // spread_over + 1).astype(np.uint64)
            bucket = ((home + mix(home * np.uint64(31) + self.hashes[word]) % ways) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((context, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.context, self.word, self.bucket = context[order], word[order], bucket[order]
        self.place = rank[place]  # of each token's bigram

    def rows(self, chunk: int) -> list[tuple[int, int, bytes]]:
        """(bucket, chunk, payload): hashes and counts of the words, and the bigrams with their number in training."""
        times = np.bincount(self.place, np.repeat(self.train, self.size), len(self.context)).astype(np.uint32)
        out = []
        for k, s, e in groups(self.bucket):
            used, number = np.unique(np.concatenate([self.context[s:e], self.word[s:e]]), return_inverse=True)
            number = number.astype(np.uint32)
            out.append((k, chunk, squeezed(self.hashes[used], self.totals[used], number[: e - s], number[e - s :], times[s:e])))
        return out


def count_bucket(rows: pd.DataFrame, unigrams: Unigrams, spread_over: int) -> pd.DataFrame:
    """Replies of a bucket to its chunks; rows with chunk -1 hold its counts of counts and its part of spread contexts."""
    parts = [unsqueezed(x) for x in rows["payload"]]
    take = lambda k, of: np.concatenate([p[of][p[k]] for p in parts])
    context, word_count = take(2, 0), take(3, 1)
    with np.errstate(over="ignore"):
        bigram = mix(mix(context) * np.uint64(31) + take(3, 0))
    _, first, place = np.unique(bigram, return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[4] for p in parts])).astype(np.int64)
    contexts, own_context = np.unique(context, return_inverse=True)
    n = len(contexts)
    total = np.zeros(n, np.int64)
    total[own_context] = take(2, 1)
    seen = counts > 0
    seen_context = own_context[first[seen]]
    kinds = np.bincount(seen_context * KINDS + np.minimum(counts[seen], KINDS) - 1, minlength=n * KINDS).reshape(n, KINDS)
    freed_from = np.bincount(seen_context, unigrams.of(word_count[first[seen]]), n)
    spread = total >= spread_over
    out = [(-1, None, None, counts_of_counts(counts[seen]).tolist(), 0.0)]
    out += [(-1, None, int(contexts[k : k + 1].view(np.int64)[0]), kinds[k].tolist(), float(freed_from[k])) for k in np.flatnonzero(spread)]
    at = 0
    for chunk, p in zip(rows["chunk"], parts):
        part = slice(at, at + len(p[2]))
        at = part.stop
        own, c = own_context[part], counts[place[part]]
        unseen = c == 0
        begins = np.concatenate([[True], p[2][1:] != p[2][:-1]])
        used = own[begins]
        wanted = np.add.reduceat(unseen, np.flatnonzero(begins)) > 0
        reply = squeezed(c.astype(np.uint64), begins.astype(np.uint8), np.where(unseen, word_count[part], 0), total[used], kinds[used].astype(np.uint32).ravel(), np.where(wanted, freed_from[used], 0.0), contexts[used][spread[used]])
        out.append((int(chunk), reply, None, None, None))
    chunk, reply, context, kinds, freed = zip(*out)
    return pd.DataFrame({"bucket": rows["bucket"].iloc[0], "chunk": chunk, "reply": reply, "context": pd.array(context, dtype="Int64"), "kinds": kinds, "freed_from": pd.array(freed, dtype="Float64")})


def bigram_values(reply: bytes, discounts: Discounts, unigrams: Unigrams, spread_over: int, spread: dict) -> np.ndarray:
    """log10 of the probability of each bigram of a reply."""
    count, begins, word_count, total, kinds, freed_from, names = unsqueezed(reply)
    count, kinds, freed_from = count.astype(np.int64), kinds.reshape(-1, KINDS).astype(float), freed_from.copy()
    for k, name in zip(np.flatnonzero(total >= spread_over), names.view(np.int64).tolist()):
        kinds[k], freed_from[k] = spread[name]
    mass = np.maximum(total, 1)
    low = kinds[:, :GOOD_TURING] * np.arange(1, GOOD_TURING + 1)
    if discounts.usable:
        seen = (low @ discounts.turing[1:] + total - low.sum(axis=1)) / mass
    else:
        seen = (total - 0.5 * kinds.sum(axis=1)) / mass
    scale = np.where(seen > 1 - 1e-12, total / (total + 1.0), 1.0)  # nothing is discounted in this context
    alpha = np.where(total > 0, backoff_weight(seen * scale, freed_from), 1.0)
    own = np.cumsum(begins) - 1
    known = np.log10(np.maximum(discounts.of(count) * count * scale[own], 1e-300) / mass[own])
    other = np.log10(alpha[own]) + np.log10(unigrams.of(word_count))
    return np.where(count > 0, known, other)


def score_texts(docs: DataFrame, bucket_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # The chunks are bucketed by what they are joined by, in as many buckets as the input has splits, and aren't shuffled.
    splits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    corpus = f"token_chunks_{uuid.uuid4().hex}"
    token_chunks(docs).write.bucketBy(min(splits, MOST_BUCKETS), "chunk").format("parquet").saveAsTable(corpus)
    chunks = spark.table(corpus)
    size = chunks.agg(F.sum("entries"), F.sum("tokens"), F.sum("trained")).first()
    if size[1] is None:
        spark.sql(f"DROP TABLE {corpus}")
        return spark.createDataFrame([], RESULT)
    totals = stored(word_totals(chunks, max(8, size[0] // bucket_tokens)), "word-totals")
    # One small row per part of the vocabulary.
    stats = [unsqueezed(x) for (x,) in totals.where("chunk = -1").select("totals").collect()]
    n, (tokens, words) = sum(s[0] for s in stats), (int(x) for x in sum(s[1] for s in stats))
    low = float((np.arange(GOOD_TURING + 1) * n[: GOOD_TURING + 1]).sum())
    unigrams = Unigrams(n, tokens, words, tokens - low)

    buckets, spread_over, starts = max(8, size[1] // bucket_tokens), bucket_tokens // 4, size[2]
    by_chunk = totals.where("chunk >= 0").groupBy("chunk").agg(F.collect_list("totals").alias("totals"))
    counted = chunks.join(by_chunk, "chunk")

    def deal(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                rows = ChunkBigrams(row, buckets, spread_over, starts).rows(row["chunk"])
                yield pa.RecordBatch.from_pydict(dict(zip(("bucket", "chunk", "payload"), zip(*rows))), schema=_PAYLOAD)

    count = lambda rows: count_bucket(rows, unigrams, spread_over)
    dealt = counted.mapInArrow(deal, "bucket int, chunk long, payload binary")
    replies = stored(dealt.groupBy("bucket").applyInPandas(count, "bucket int, chunk long, reply binary, context long, kinds array<long>, freed_from double"), "bigram-counts")
    most = max(GOOD_TURING + 2, KINDS)
    sums = replies.where("chunk = -1").groupBy("context").agg(*(F.sum(F.get("kinds", F.lit(k))).alias(f"k{k}") for k in range(most)), F.sum("freed_from").alias("freed_from")).collect()
    discounts = Discounts(next(np.array(s[1 : GOOD_TURING + 3], float) for s in sums if s["context"] is None))
    spread = {s["context"]: (np.array(s[1 : KINDS + 1], float), s["freed_from"]) for s in sums if s["context"] is not None}

    def texts(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                c = ChunkBigrams(row, buckets, spread_over, starts)
                value = np.concatenate([bigram_values(r["reply"], discounts, unigrams, spread_over, spread) for r in sorted(row["replies"], key=lambda r: r["bucket"])])
                times = c.totals[c.stream]
                base = np.log10((times + 1) / (unigrams.tokens + unigrams.words + 1))
                per_text = lambda x: np.add.reduceat(x, c.first)
                columns = [pa.array(c.doc_id, mask=c.null), pa.array(~c.train), pa.array(c.size.astype(np.int64)), pa.array(per_text((times > 0).astype(np.int64))), pa.array(np.full(len(c.size), tokens)), pa.array(per_text(base)), pa.array(per_text(value[c.place]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    by_chunk_too = replies.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    result = stored(counted.join(by_chunk_too, "chunk").mapInArrow(texts, RESULT), "scores")
    spark.sql(f"DROP TABLE {corpus}")
    return result
