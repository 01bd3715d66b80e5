"""Operator 8: language-model scores from a probabilistic suffix tree.

The symbols are bytes. A text is its words in small letters with a space between them and an end
behind the last one; contexts are the bytes before a symbol, across words, back to the beginning of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from fluxbook.llm.staging import staged
from fluxbook.llm.texts import BASE, IS_SPACE, LOWERED, span_hashes, text_slices, words_of

#: Longest context in bytes; a context and its symbol are one number of 64 bits, so 7 is the most.
DEPTH = 5
SPACE, END = 0x20, 0x0A
SYMBOLS = 256
#: Bytes that are worked on at once, and bytes of texts whose different grams and words are asked for together.
PIECE_BYTES, CHUNK_BYTES = 1 << 18, 32 << 20


@dataclass(frozen=True)
class TreeSettings:
    """A context is retained if its distribution of the next symbol tells its own training
    occurrences, each left out in turn, better than its suffix does: by at least ``evidence``
    nats in all and ``divergence`` for each. ``drawn``: count that the suffix's distribution gets
    in the smoothing."""

    divergence: float = 0.01
    evidence: float = 10.0
    drawn: float = 4.0
    depth: int = DEPTH


def gram_logs(grams: DataFrame, settings: TreeSettings) -> DataFrame:
    """``key`` and ``log``, the log10 probability of a gram's symbol from the longest retained suffix of its context.

    ``grams`` holds each ``key`` (the symbol in the lowest byte, the context above, its last symbol lowest) once and its training count
    ``n``, 0 for those that are only asked for. The lower bytes of a gram are the gram with a shorter context, so
    each length of context is a sum over the next one and a join with the one before.
    """
    drawn, n, ten = settings.drawn, F.col("n"), F.pow(F.lit(10.0), "log")
    low = lambda size: F.col("key").bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))
    single = staged(grams.groupBy(low(1).alias("key")).agg(F.sum("n").alias("n")), "lm-symbols")
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = single.select("key", F.log10((n + 1) / F.lit(float(total + SYMBOLS))).alias("log"))
    for d in range(1, settings.depth + 1):
        level = grams if d == settings.depth else grams.groupBy(low(d + 1).alias("key")).agg(F.sum("n").alias("n"))
        pair = level.select("key", "n", F.shiftright("key", 8).alias("context"), low(d).alias("shorter")).join(
            known.withColumnRenamed("key", "shorter"), "shorter"
        )
        likely = F.when(n == 1, F.lit(math.log(drawn))).when(n > 1, F.log(n - 1 + drawn * ten) - F.col("log") * math.log(10))
        tested = pair.groupBy("context").agg(F.sum("n").alias("total"), F.sum(n * likely).alias("gain")).filter("total > 0")
        gain = F.col("gain") - F.col("total") * F.log(F.col("total") - 1 + drawn)
        kept = tested.filter((gain >= settings.evidence) & (gain >= settings.divergence * F.col("total"))).select("context", "total")
        below = F.log10(F.col("total") + drawn)
        log = (
            F.when(F.col("total").isNull(), F.col("log"))
            .when(n > 0, F.log10(n + drawn * ten) - below)
            .otherwise(F.col("log") + math.log10(drawn) - below)
        )
        known = staged(pair.join(kept, "context", "left").select("key", log.alias("log")), f"lm-grams-{d}")
    return known


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of a long text that begin at a space; a word is never cut."""
    start = 0
    while start < len(data):
        stop = min(start + PIECE_BYTES, len(data))
        while stop < len(data) and not IS_SPACE[data[stop]]:
            spaces = np.flatnonzero(IS_SPACE[data[stop:stop + PIECE_BYTES]])
            stop = stop + int(spaces[0]) if len(spaces) else min(stop + PIECE_BYTES, len(data))
        yield start, stop
        start = stop


def words_in(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice its first and end row and the hashes and rows of its words."""
    for first, end, data, offsets in text_slices(texts, PIECE_BYTES):
        for start, stop in (_cuts(data) if end - first == 1 else [(0, len(data))]):
            own = data[start:stop]
            starts, ends, rows = words_of(own, offsets if end - first > 1 else np.array([0, len(own)]))
            yield first, end, span_hashes(own, starts, ends, LOWERED).view(np.int64), rows


def _packed(line: np.ndarray, n: int) -> np.ndarray:
    """Of each place the ``n`` bytes up to it as one number, the last one lowest; runs of bytes are doubled, not shifted one by one."""
    power, size = line.astype(np.int64), 1
    out, have = None, 0
    late = lambda x, k: np.concatenate([np.zeros(k, np.int64), x[:len(x) - k]]) if k else x
    while True:
        if n & size:
            out = power if out is None else out | late(power, have) << (8 * have)
            have += size
        if 2 * size > n:
            return out
        power = power | late(power, size) << (8 * size)
        size *= 2


def grams_of(texts: pa.Array, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece its first and end row, the words (hashes, rows) and the grams (numbers, rows) in it.

    A gram holds a symbol in its lowest byte and the ``depth`` symbols before it above that, the last one lowest;
    in front of a text there are ends. A text longer than a piece comes in several.
    """
    for first, end, data, offsets in text_slices(texts, PIECE_BYTES):
        pieces = list(_cuts(data)) if end - first == 1 and len(data) > 2 * PIECE_BYTES else [(0, len(data))]
        tail, begun = np.full(depth, END, np.uint8), False
        for start, stop in pieces:
            own = data[start:stop]
            edges = offsets if len(pieces) == 1 else np.array([0, len(own)])
            starts, ends, rows = words_of(own, edges)
            sizes, n, closes = ends - starts, end - first, int(stop == len(data))
            follows = np.append(begun, rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, bool)
            spans = sizes + follows
            # each text has what stands before it in front: ends, or the tail of the piece before
            out = np.cumsum(spans) - spans + rows * closes + follows + (rows + 1) * depth
            totals = np.bincount(rows, spans, minlength=n).astype(np.int64) + closes + depth
            line = np.full(int(totals.sum()), SPACE, np.uint8)
            inside = np.arange(int(sizes.sum())) + np.repeat(out - (np.cumsum(sizes) - sizes), sizes)
            line[inside] = LOWERED[own[~IS_SPACE[own]]]
            heads = np.cumsum(totals) - totals
            if closes:
                line[heads + totals - 1] = END
            front = (heads[:, None] + np.arange(depth)).ravel()
            line[front] = np.tile(tail, n)
            counts = np.ones(len(line), bool)
            counts[front] = False
            row = np.repeat(np.arange(n), totals - depth)
            yield first, end, span_hashes(own, starts, ends, LOWERED).view(np.int64), rows, _packed(line, depth + 1)[counts], row
            tail, begun = line[len(line) - depth:], begun or len(rows) > 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in compressed blocks with the number of their chunk; a new one begins when the last has its bytes."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for first, end, data, _ in text_slices(batch.column("text"), PIECE_BYTES):
            if held and held + len(data) > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += len(data)
            sink = pa.BufferOutputStream()
            own = batch.slice(first, end - first)
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(own)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "block"])


def _rows_of(block: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(block.as_buffer()).read_next_batch()


class _Tally:
    """Different keys with how often they are learned from; what has come in is merged when it outgrows the rest."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, learned: np.ndarray) -> None:
        for own, counts in ((keys[learned], True), (keys[~learned], False)):
            different, n = np.unique(own, return_counts=True)
            self.new.append((different, n if counts else np.zeros(len(n), np.int64)))
            self.size += len(different)
        if self.size > len(self.keys) // 2 + PIECE_BYTES:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.new]])
        counts = np.concatenate([self.counts, *[c for _, c in self.new]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[begins]
        self.counts = np.add.reduceat(counts[order], begins) if len(begins) else np.zeros(0, np.int64)
        self.new, self.size = [], 0


class _Places:
    """Places of keys in an array of different ones, by a hash table with few collisions. Every key asked for is there."""

    def __init__(self, keys: np.ndarray):
        bits = max(int(np.ceil(np.log2(max(len(keys), 1)))) + 2, 4)
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * BASE) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        place = self.table[slot]
        miss = np.flatnonzero(self.keys[place] != keys) if len(keys) else np.zeros(0, np.int64)
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            place[miss] = self.table[slot[miss]]
            miss = miss[self.keys[place[miss]] != keys[miss]]
        return place


def _asked(depth: int, words: bool):
    """Per chunk its different words, or grams, and how often each is there to be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, chunk = _Tally(), None

        def out() -> pa.RecordBatch:
            tally.merge()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(tally.keys), chunk)), pa.array(tally.keys), pa.array(tally.counts)], names=["chunk", "key", "n"])

        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if chunk is not None and number != chunk:
                    yield out()
                    tally = _Tally()
                chunk, rows = number, _rows_of(block)
                learned = ~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                if words:
                    for first, end, hashes, of_row in words_in(rows.column("text")):
                        tally.add(hashes, learned[first:end][of_row])
                else:
                    for first, end, _, _, grams, of_row in grams_of(rows.column("text"), depth):
                        tally.add(grams, learned[first:end][of_row])
        if chunk is not None:
            yield out()

    return run


def shared_counts(asked: DataFrame) -> DataFrame:
    """Of words in several chunks (``chunk``, ``key``) their count ``c`` in all; and with NULL for both, all counts and kinds together.

    A word has at most one row a chunk. Most words are in one chunk only, which knows their count itself.
    """
    by = Window.partitionBy("key")
    told = asked.withColumns({"c": F.sum("n").over(by), "chunks": F.count("*").over(by), "first": F.row_number().over(by.orderBy("chunk")) == 1})
    several = F.col("chunks") > 1
    once = F.when(F.col("first"), F.col("c"))
    return told.groupBy(F.when(several, F.col("chunk")).alias("chunk"), F.when(several, F.col("key")).alias("key")).agg(
        F.max("c").alias("c"), F.sum(once).alias("tokens"), F.count_if(once > 0).alias("kinds")
    )


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", settings: TreeSettings = TreeSettings(),
) -> DataFrame:
    """The id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every document.

    ``held_out`` is a condition; the other documents are learned from. ``score`` is the log10 probability
    of a text's bytes, each drawn from the longest retained suffix of the bytes before it; as every
    byte can follow every context, each text has a probability. ``base_score`` is that of single
    words with added ones.

    The texts are written once, in compressed blocks with the number of a chunk of some tens of megabytes. A chunk asks
    for its different grams (a byte with the bytes before it). These are counted over all chunks, which gives the
    tree as tables, one for each length of context; every gram is scored once and joined back to the chunks that ask
    for it, which add up their documents. Counts of words go the same way, but only for words of several chunks. No
    table of the model is held anywhere. Words are told apart by 64-bit hashes.

    NULL and empty texts are an end only; a NULL id is not held out; repeated rows are learned
    and scored each; an empty table gives no rows; other columns are left aside. A text longer
    than a piece is worked on in pieces.
    """
    depth = settings.depth
    chosen = docs.select(F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType
    blocks = staged(chosen.mapInArrow(_blocks, "chunk long, block binary"), "lm-texts")
    found = "chunk long, key long, n long"
    words = staged(shared_counts(blocks.mapInArrow(_asked(depth, True), found)), "lm-words")
    seen = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    ends = chosen.filter("not held_out").count()
    tokens, kinds = seen["tokens"] + ends, seen["kinds"] + (ends > 0)
    asked = staged(blocks.mapInArrow(_asked(depth, False), found), "lm-asked")
    grams = staged(asked.groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    logs = asked.select("chunk", "key").join(gram_logs(grams, settings), "key")
    answers = logs.select("chunk", "key", F.col("log").alias("value"), F.lit(False).alias("word")).unionByName(
        words.filter("chunk is not null").select("chunk", "key", F.col("c").cast("double").alias("value"), F.lit(True).alias("word"))
    )
    share = math.log10(tokens + kinds + 1)

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Tally()
        for block in chunk["block"]:
            rows = _rows_of(block)
            learned = ~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for first, end, hashes, word_rows in words_in(rows.column("text")):
                own.add(hashes, learned[first:end][word_rows])
        own.merge()
        word, keys, values = (answers[c].to_numpy() for c in ("word", "key", "value"))
        counts = own.counts.copy()
        counts[np.searchsorted(own.keys, keys[word])] = values[word]
        base, log = np.log10(counts + 1), values[~word]
        word_places, gram_places = _Places(own.keys), _Places(keys[~word])
        made = []
        for block in chunk["block"]:
            rows = _rows_of(block)
            n = rows.num_rows
            n_words, n_known, base_sum, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for first, end, hashes, word_rows, grams, gram_rows in grams_of(rows.column("text"), depth):
                at, size = word_places.of(hashes), end - first
                n_words[first:end] += np.bincount(word_rows, minlength=size)
                n_known[first:end] += np.bincount(word_rows[counts[at] > 0], minlength=size)
                base_sum[first:end] += np.bincount(word_rows, base[at], minlength=size)
                score[first:end] += np.bincount(gram_rows, log[gram_places.of(grams)], minlength=size)
            made.append(pa.table({
                "id": rows.column("id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(n_words + 1), "n_known": pa.array(n_known + (ends > 0)),
                "train_tokens": pa.array(np.full(n, tokens)), "base_score": pa.array(base_sum + math.log10(ends + 1) - (n_words + 1) * share), "score": pa.array(score),
            }))
        return pa.concat_tables(made)

    result = T.StructType([
        T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    return blocks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, result).withColumnRenamed("id", id_col)


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_texts(spark.read.parquet(f"{folder}/documents.parquet"), held)
