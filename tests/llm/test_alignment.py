"""Two tokenizers' tokens over the same bytes, against brute force over whole texts."""

import hashlib
import random
from collections import Counter
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forgelens.llm import alignment
from forgelens.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_path

A, B = tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)


@cache
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return a, SentencePieceProcessor(model_file=B), letters


def spans(parts):
    ends, at = [], 0
    for p in parts:
        ends.append((at, at + len(p)))
        at += len(p)
    return ends


def brute(text):
    """(n_a, n_b, groups as text, links as pairs of ids), or None."""
    a, b, letters = tokenizers()
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return None
    at_a, at_b = spans(parts_a), spans(parts_b)
    both = {e for _, e in at_a} & {e for _, e in at_b}
    number = {e: i for i, e in enumerate(sorted(both))}
    shown = [([], []) for _ in both]
    for side, ids, at in ((0, ids_a, at_a), (1, ids_b, at_b)):
        group = 0
        for i, (_, e) in zip(ids, at):
            shown[group][side].append(str(i))
            group = number[e] + 1 if e in both else group
    shown = [",".join(x) + "|" + ",".join(y) for x, y in shown]
    links, j = [], 0
    for i, (s, e) in enumerate(at_a):
        while j and at_b[j][0] > s:
            j -= 1
        while at_b[j][1] <= s:
            j += 1
        k = j
        while k < len(at_b) and at_b[k][0] < e:
            links.append((ids_a[i], ids_b[k]))
            k += 1
    return len(ids_a), len(ids_b), ";".join(shown), links


def brute_rows(rows):
    found = [brute(t) for _, t in rows]
    count = Counter(p for x in found if x for p in set(x[3]))
    most = Counter()
    for (a, _), c in count.items():
        most[a] = max(most[a], c)
    out = []
    for (doc_id, _), x in zip(rows, found):
        n_a, n_b, shown, links = x or (0, 0, "", [])
        out.append((doc_id, n_a, n_b, shown.count(";") + 1 if x else 0, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if x else ""))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def same(found, want):
    key = lambda r: [(x is not None, x or 0) for x in r[:1]] + list(map(str, r))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=key) == sorted(want, key=key)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcXYZéßñİſ' \t\n\x85\x1c\0.,!?*09😀́<|>▁　中文", "  ", "   ", " the", "ing ", "<|endoftext|>", "</s>", "<0x0A>", "tokenization"]), max_size=30).map("".join))
def test_pieces_give_the_groups_of_whole_texts(text):
    found, want = next(alignment.Aligner.of(A, B).align([text])), brute(text)
    if want is None:
        assert found is None
    else:
        assert (found[0], found[1], found[3]) == want[:3] and found[2] == want[2].count(";") + 1
        size = alignment.Aligner.of(A, B).size
        assert Counter((int(c) // size, int(c) % size) for c in np.frombuffer(found[4], "<i8")) == Counter(want[3])


def test_labels_and_groups():
    ends = lambda *lengths: np.cumsum(lengths)
    assert alignment.labels(ends(1, 2, 3), ends(3, 1, 2), 6) == bytes([1, 0, 3, 2, 0, 3])
    assert alignment.group_ends(bytes([1, 0, 3, 2, 0, 3])).tolist() == [3, 6]
    label = alignment.labels(ends(10, 1), ends(5, 5, 1), 11)
    assert alignment.group_ends(label).tolist() == [10, 11] and label[9] == 3


@pytest.mark.parametrize("unit_bytes", [8 << 20, 700])
def test_alignment(spark, messy, monkeypatch, unit_bytes):
    monkeypatch.setattr(alignment, "UNIT_BYTES", unit_bytes)
    rng = random.Random(unit_bytes)
    words = "the and Überraschung naïve tokenization Größe l'été 1234567 x_y_z ---- señor http://a.b/c 😀 don't".split()
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", " ", "  ", "\n", ", "]) for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += ["a copy that many have"] * 60 + [None, "", " ", "▁", "has ▁ in it", "<|endoftext|> as text"]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[3])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("unit", F.lit("x"))
    same(alignment.align(d, A, B).collect(), brute_rows(rows))
    same(alignment.align(messy, A, B).collect(), brute_rows([(r["doc_id"], r["text"]) for r in messy.collect()]))
    assert alignment.align(messy.limit(0), A, B).collect() == []


def test_alignment_of_the_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = alignment.align(d, A, B).collect()
    same(found, brute_rows([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]))
    assert sum(r["n_links"] for r in found) == sum(r["n_a"] + r["n_b"] - r["n_groups"] for r in found) > 0
