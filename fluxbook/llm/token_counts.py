"""Operator 4: token counts; huge documents are encoded in overlapping chunks and spliced."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, types as T

from fluxbook.llm.texts import map_texts, span_hashes, U64

#: Documents with more bytes are encoded in chunks.
HUGE_BYTES = 1 << 16
CHUNK_CHARS, OVERLAP_CHARS = 1 << 14, 256
#: A boundary this far from a chunk's end does not depend on what follows: one character of
#: look-ahead for white space, two for contractions, twelve for a special string cut short.
GUARD_CHARS = 16
BATCH = 2000
MEMO = 1 << 20
LIMIT = 1024


def pieces_with_offsets(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Character starts of the tokens of an encoding, and which of them start a pre-token."""
    starts = np.array([a for a, _ in encoding.offsets], np.int64)
    words = np.array([-1 - i if w is None else w for i, w in enumerate(encoding.word_ids)], np.int64)
    first = np.ones(len(starts), bool)
    first[1:] = words[1:] != words[:-1]
    return starts, first


def count_in_chunks(text: str, encode: Callable[[list[str]], list], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` from overlapping chunks.

    A chunk is exact from a place where a pre-token of the whole text starts up to a guard in
    front of its end, since what is cut next depends on the text from there only. Where the next
    chunk starts a pre-token at a start of the exact part, it is exact from there on: the counts
    are spliced at the first such place. If there is none, the next chunk begins earlier, with
    twice the overlap, at last where the exact part begins.
    """
    total, exact, begin, end = 0, 0, 0, min(chunk, len(text))
    starts, first = pieces_with_offsets(encode([text[begin:end]])[0])
    while end < len(text):
        width, next_end = overlap, min(end + chunk, len(text))
        while True:
            next_begin = max(end - width, exact)
            next_starts, next_first = pieces_with_offsets(encode([text[next_begin:next_end]])[0])
            if next_begin == exact:
                splice = exact
                break
            own = begin + starts[first]
            own = own[(own > next_begin) & (own >= exact) & (own <= end - GUARD_CHARS)]
            common = own[np.isin(own, next_begin + next_starts[next_first])]
            if len(common):
                splice = int(common[0])
                break
            width *= 2
        total += int(((begin + starts >= exact) & (begin + starts < splice)).sum())
        exact, begin, end, starts, first = splice, next_begin, next_end, next_starts, next_first
    return total + int((begin + starts >= exact).sum())


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of spaces between two characters that are no white space.

    A pre-token always starts there, whatever stands around: no run in front of a space goes on
    behind it, the space belongs to what follows, and no special string holds one. Characters are
    taken from ASCII and Latin-1 letters, none of which is white space.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    latin = (before >= 0x80) & (before < 0xC0) & (data[np.maximum(at - 2, 0)] == 0xC3) & (at > 1)
    solid = ((before > 0x20) & (before < 0x7F)) | latin
    at = at[solid & (((after > 0x20) & (after < 0x7F)) | (after == 0xC3))]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    return at[~edge[at] & ~edge[at + 1]]


def _counting(tokenizer: str, huge: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    library.no_truncation()
    library.no_padding()
    encode = lambda texts: library.encode_batch(texts, add_special_tokens=False)
    # spaces are sure places, and chunks can be spliced, with a byte-level pre-tokeniser on the text as it is
    plain = type(library.pre_tokenizer).__name__ == "ByteLevel" and library.normalizer is None
    memo = {"hashes": np.zeros(0, U64), "tokens": np.zeros(0, np.int64)}

    def counted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece; each different piece is encoded once and remembered."""
        kinds, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(memo["hashes"], kinds), max(len(memo["hashes"]) - 1, 0))
        known = memo["hashes"][place] == kinds if len(memo["hashes"]) else np.zeros(len(kinds), bool)
        tokens = np.zeros(len(kinds), np.int64)
        tokens[known] = memo["tokens"][place[known]]
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        for k in range(0, len(new), BATCH):
            part = new[k:k + BATCH]
            texts = [raw[a:b].decode() for a, b in zip(starts[example[part]].tolist(), ends[example[part]].tolist())]
            tokens[part] = [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        if len(memo["hashes"]) + len(new) > MEMO:
            memo.update(hashes=kinds, tokens=tokens)
        elif len(new):
            hashes = np.concatenate([memo["hashes"], kinds[new]])
            order = np.argsort(hashes, kind="stable")
            memo.update(hashes=hashes[order], tokens=np.concatenate([memo["tokens"], tokens[new]])[order])
        return tokens[which]

    def kernel(batch, first, end, data, offsets):
        n_bytes = np.diff(offsets)
        n_tokens = np.zeros(len(n_bytes), np.int64)
        small = (n_bytes <= huge) | (not plain)
        if small.any():
            starts = np.sort(np.concatenate([offsets[:-1][n_bytes > 0], _cuts(data, offsets) if plain else offsets[:0]]))
            ends = np.append(starts[1:], len(data))
            rows = np.searchsorted(offsets, starts, "right") - 1
            own = small[rows]
            tokens = counted(data, starts[own], ends[own])
            n_tokens += np.bincount(rows[own], tokens, minlength=len(n_bytes)).astype(np.int64)
        for row in np.flatnonzero(~small):
            n_tokens[row] = count_in_chunks(data[offsets[row]:offsets[row + 1]].tobytes().decode(), encode)
        return {"n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > LIMIT}

    return kernel


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE_BYTES) -> DataFrame:
    """The id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document, as the tokenizer's library counts.

    ``tokenizer`` is the path of a file that the executors have too. Texts are cut where a
    pre-token surely starts and each different piece is encoded once per task, or, if they are
    huge, encoded in chunks; with a tokenizer whose pre-tokeniser is not byte-level or that normalises texts, each text is
    encoded as a whole. NULL and empty texts have no tokens; repeated rows are counted each;
    an empty table gives no rows; other columns are left aside.
    """
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return map_texts(docs, text_col, [id_col], added, lambda: _counting(tokenizer, huge))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
