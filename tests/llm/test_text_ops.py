"""Infilling, alignment and token counts against brute force, on odd rows."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgtide.llm import align, counts, infill

R = random.Random(11)
WORDS = ["the", "of", "réseau", "Straße", "don't", "x86", "日本語テキスト", "naïve,", "<|endoftext|>", "ok!!", "a\nb", "\tq", "</s>", "ét", "12345", "...", "😀", " z", "un​sichtbar"] + [f"w{i}" for i in range(300)]


def prose(n):
    return "".join(R.choice(WORDS) + (" " if R.random() < 0.95 else R.choice(["  ", "\n", " \n", "\n ", "\n \n", "   ", "　 "])) for _ in range(n))


TEXTS = [prose(R.randint(1, 300)) for _ in range(80)]
TEXTS += [None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  ", "  a  b ", "▁a", "a ▁ b", "x▁", "a\x00b", "<0x41>", "\t x", "a   b", "a \x1c b", "\x85 c", "🙂 🙂", "word" * 200, "z" * 300 + " y"]
TEXTS += ["has <P> mark", "has <S>", "x<M>", "< P>", "<<P", "S> <", prose(25_000), prose(40), prose(40)]
ROWS = [(i if i != 3 else None, t, "en") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en")] * 2 + [(None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    for extra in ("n", "u", "h", "form", "output", "batch", "pairs", "times", "row", "count", "piece", "n_tokens", "pair", "best"):
        frame = frame.selectExpr("*", f"'x' as {extra}")
    return frame


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is not None, v) for v in r])


def formed(doc, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), sha(f"42:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_infilling(docs):
    want = [formed(d, t) for d, t, _ in ROWS]
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    got = infill.restore(infill.fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert order(got) == order(want)
    got = infill.op11_infill(docs).collect()
    assert order(got) == order([(*w[:5], sha(w[5]), sha(w[6])) for w in want])
    assert infill.op11_infill(docs.filter("false")).count() == 0


def test_long_batches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(infill, "BYTES", 2000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], names=["doc_id", "text"])
    parts = list(infill._run("SELECT doc_id, length(text) AS n FROM batch", batch))
    assert len(parts) > 10 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(TEXTS)))


@pytest.fixture(scope="module")
def brute():
    """Both libraries' ids of a text, whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = align.byte_letters()
    names = {i: t for t, i in json.load(open(path_a, encoding="utf-8"))["model"]["vocab"].items()}

    def ids(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in names[i]) for i in x]
        bytes_b = [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in map(b.id_to_piece, y)]
        return x, y, bytes_a, bytes_b

    return ids


def aligned(brute, text):
    """(a ids, b ids) of each group by walking through both lists."""
    if not text:
        return []
    a, b, bytes_a, bytes_b = brute(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def test_alignment(docs, brute):
    found = [(d, aligned(brute, t)) for d, t, _ in ROWS]
    links = Counter((x[-1], y[-1]) for _, groups in found for x, y in groups)
    most = {}
    for (_, y), k in links.items():
        most[y] = max(most.get(y, 0), k)
    want = []
    for d, groups in found:
        counted = [(links[x[-1], y[-1]], most[y[-1]]) for x, y in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        want.append((d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(groups), sum(k == m for k, m in counted), sum(k for k, _ in counted), sha(text) if groups else ""))
    assert sum(not g for _, g in found) >= 6 and any(len(x) > 1 and len(y) > 1 for _, g in found for x, y in g)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(align.op12_alignment(docs).select(cols).collect()) == order(want)
    assert align.op12_alignment(docs.filter("false")).count() == 0


def test_alignment_without_broadcast(docs, monkeypatch):
    want = order(align.op12_alignment(docs).collect())
    monkeypatch.setattr(align, "LISTED", 3)
    assert order(align.op12_alignment(docs).collect()) == want


def test_long_texts_are_aligned_in_parts(brute, monkeypatch):
    one = align.aligner(*align.vocabularies())
    texts = [t for t in TEXTS if t] + [prose(3000)]
    want = [one.document(t) for t in texts]
    monkeypatch.setattr(align, "CHUNK", 50)
    monkeypatch.setattr(align, "CACHE", 40)
    one.cache.clear()
    for got in (one.documents(texts), [one.document(t) for t in texts]):
        for x, y in zip(got, want, strict=True):
            assert (x is None) == (y is None) and (x is None or (x[:4] == y[:4] and all(np.array_equal(p, q) for p, q in zip(x[4:], y[4:], strict=True))))
    assert len(one.cache) < 400


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab'sé. \n\t 　日1\x00\x1c\x85<|>"), max_size=40))
def test_alignment_of_any_text(brute, text):
    one = align.aligner(*align.vocabularies())
    got, want = one.document(text), aligned(brute, text)
    assert (got is None) == (not want)
    if got:
        assert got[3] == sha(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want))
        assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == Counter(x[-1] << 32 | y[-1] for x, y in want)


def test_ranks_by_bit_counts():
    r = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 500):
        a, b = (np.unique(np.append(r.integers(1, size + 1, size // 3), size)) for _ in range(2))
        cuts, upto_a, upto_b = align.shared_cuts(a, b, size)
        assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert upto_a.tolist() == [int((a <= c).sum()) for c in cuts] and upto_b.tolist() == [int((b <= c).sum()) for c in cuts]


def test_token_counts(docs):
    library = counts.Counters(counts.default_model()).library
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t, _ in ROWS]
    assert {w[3] for w in want} == {True, False}
    assert order(counts.op13_token_counts(docs).collect()) == order(want)
    assert order(counts.token_counts(docs, sample=0).collect()) == order([w[:3] for w in want])
    assert counts.op13_token_counts(docs.filter("false")).count() == 0


def test_tiers_are_bounded(monkeypatch):
    monkeypatch.setattr(counts, "CACHE", 30)
    monkeypatch.setattr(counts, "CHUNK", 60)
    count = counts.Counters(counts.default_model())
    assert count.by_pieces
    want = [len(count.library.encode(t or "")) for t in TEXTS]
    assert count.counts(TEXTS) == want
    count.take((b"the of w1 don't", np.array([len(count.library.encode(x)) for x in ("the", "of", "w1", "don't")], np.uint16).tobytes()))
    assert count.counts(TEXTS) == want and "the" not in count.cache and len(count.cache) <= 30


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab. \n\t▁日1\x00<s>/"), max_size=40))
def test_counts_of_any_text(text):
    count = counts.counters(counts.default_model())
    assert count.counts([text]) == [len(count.library.encode(text))]
