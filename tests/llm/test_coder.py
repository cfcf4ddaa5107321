"""The cached coder against the tokenizers library itself."""

import numpy as np
import public_tokenizers
import pytest

from kgtide.llm.tokens import Coder, default_vocabulary

TEXTS = [
    None, "", " \n\t ", "it's DON'T we've they'll x'd", "a<|b c|>d <|endoftext|> e", "Ünïcode ÀÉ½²µ ªº 1½ ß SS ıİ", "日本語 テスト ١٢٣ é 😀",
    "''s '' 's'S", "«×÷» a×b ¿¡", "a'sb 12a3 _-_ \x1c\x1d\x85 q", "word " * 5000, "x" * 20_000, " ".join(f"tok{i} Zz{i:x}q" for i in range(9000)),
]


@pytest.fixture(scope="module")
def code():
    return Coder(default_vocabulary())


def plain(code, text):
    return np.array(code.tok.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_those_of_the_library(code):
    for text in TEXTS + TEXTS[::-1]:
        assert code.packed(text) == plain(code, text)


def test_runs_that_do_not_fit_fall_back(code):
    # An empty piece gives one run less than there are pieces.
    pieces = ["ab", "cd", ""]
    assert code._encode(pieces) == [plain(code, p) for p in pieces]


def test_odd_words_within_plain_text(code):
    text = "Plain “quoted” text—with İx, a<|b <|endoftext|> x<|startoftext|>y and don''t, 12a3 <| |> ﬁn\x1cb " * 50
    assert code.packed(text) == plain(code, text)


def test_other_vocabularies_are_encoded_plainly():
    other = Coder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_pieces
    for text in TEXTS:
        assert other.packed(text) == plain(other, text)


def test_ids_of_the_documents(code, sf_dir):
    import pyarrow.parquet as pq

    for text in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert code.packed(text) == plain(code, text)
