"""Operator 4 against the library itself, texts in one piece and in chunks."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fluxbook.llm.token_counts import count_tokens

FILE = "byte_bpe_50k.json"


def expected(texts, file=FILE):
    library = Tokenizer.from_file(public_tokenizers.path(file))
    library.no_truncation()
    library.no_padding()
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("huge", [1 << 20, 300])
def test_equals_library(documents, corpus, huge):
    found = count_tokens(documents, public_tokenizers.path(FILE), huge=huge).collect()
    counts = expected([r[1] for r in corpus])
    wanted = [(r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(corpus, counts)]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("huge", [1 << 20, 200])
def test_marks_spaces_and_special_strings(frame, huge):
    rng = random.Random(1)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\n\n ", " ", "　", "é", "汉字", "🙂", "don't", "'s", "...", "12345", "x_y", "É", "à ", "​", "ÿ", "Ã", "word", "Ωmega"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 200))) for _ in range(120)]
    found = {r["doc_id"]: r["n_tokens"] for r in count_tokens(frame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path(FILE), huge=huge).collect()}
    assert [found[i] for i in range(len(texts))] == expected(texts)


def test_other_tokenizers_read_whole_texts(documents, corpus):
    """One that drops white space and lowers case: no place in a text is sure."""
    file = "word_bpe_49k.json"
    found = count_tokens(documents, public_tokenizers.path(file), huge=300).collect()
    wanted = [(r[0], n) for r, n in zip(corpus, expected([r[1] for r in corpus], file))]
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in found], key=str) == sorted(wanted, key=str)


def test_empty(no_documents):
    assert count_tokens(no_documents, public_tokenizers.path(FILE)).collect() == []
