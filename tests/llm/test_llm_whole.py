"""Operators do the whole job where they once did a part of it."""

import re
from collections import Counter

from kgtide.llm import mixing, pii, simhash


def test_iban_before_upper_case_words_and_numbers():
    iban = "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC COBADEFF", " EUR 500", " 500", ", BIC X", " A", " USD 12 PER UNIT OF 7 AND MORE"):
        text = f"Pay to IBAN {iban}{after}"
        assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "account"] == [iban], after
        assert pii.redact(text) == f"Pay to IBAN <ACCOUNT>{after}"
    longest = "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    assert pii.redact(f"IBAN {longest} EUR 500 on demand") == "IBAN <ACCOUNT> EUR 500 on demand"
    assert pii.find_spans("IBAN DE89 3704 0044 0532 0130 01 EUR 500") == []


def test_mixed_rows_are_the_selected_words(spark):
    text = lambda i, n: "".join(f"d{i}w{k}" + (" " if k % 7 else "\n\n") for k in range(n))
    rows = [(i, text(i, 37 + i), f"s{i % 3}") for i in range(12)] + [(90, text(90, 3000), "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, inside = Counter(), 0
    for r in mixing.mix(docs).collect():
        words = rows[[x[0] for x in rows].index(r["doc_id"])][1].split()
        runs = [(0, r["size"])] * r["_passes"] + [(r["_from"], r["_upto"]), (0, r["_head"])]
        assert sum(b - a for a, b in runs) == r["taken"]
        inside += r["_from"] > 0 and r["_from"] < r["_upto"]
        want.update((r["doc_id"], *words[a:b]) for a, b in runs if a < b)
    got = mixing.mixed_rows(docs).collect()
    assert Counter((r["doc_id"], *r["text"].split()) for r in got) == want and inside
    texts = {d: t for d, t, _ in rows}
    assert all(r["text"] in texts[r["doc_id"]] and r["text"] for r in got)
    assert any(re.search("\n", r["text"]) and r["text"] != texts[r["doc_id"]] for r in got)


def test_one_row_of_each_component_stays(spark):
    text = lambda i, n=200: " ".join(f"t{i}w{k * (i + 3) % 101}" for k in range(n))
    near = [text(9).replace(f"t9w{k}", "x", 1) for k in (0, 60)]
    rows = [(1, text(1)), (1, text(2)), (2, text(2)), (None, near[0]), (None, near[1]), (None, near[1]), (5, text(3)), (5, text(3)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [simhash.fingerprint(t) for t in near]
    assert fps[0] != fps[1] and (fps[0] ^ fps[1]).bit_count() <= simhash.RADIUS
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    groups = [{(1, text(1))}, {(1, text(2))}, {(None, t) for t in near}, {(5, text(3))}, {(None, None)}]
    assert len(got) == len(groups) and all(len(g & set(got)) == 1 for g in groups)
