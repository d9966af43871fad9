"""The ten operators on small cases: brute force, round trips, and rows with nulls, ties and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forgelens.llm import decontamination, language, line_dedup, near_duplicates, packing, pii, quality, sharding, sketches, slices, tables, token_files, tokens, top_k
from forgelens.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path
from forgelens.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)) + "."


def docs(spark, texts, schema=DOCS):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)] if not texts or not isinstance(texts[0], tuple) else texts
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, a long one, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n ", "en", "s", 4), (4, long, "en", "s", 5), (None, "a null id has text", "en", "s", 1), (5, "same text here", "en", "s", 1), (5, "same text here", "en", "s", 1)]
    clash = ("score", "shard", "slot", "n", "rep", "hits", "items", "label", "runs", "key", "size", "lines_dropped", "doc", "h", "hs", "f", "_gone", "_again", "id", "name", "law")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in clash})


# Encoder, packing, files of ids


@cache
def plain(name):
    """The library's tokenizer as the file has it."""
    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"abcXYZéßñİſ' \t\n\x85\x1c\0.,!?*09😀́<|>", "<|endoftext|>", "<|StartOfText|>"]), max_size=40).map("".join))
def test_chunks_give_the_library_s_ids(name, text):
    want = plain(name).encode(text, add_special_tokens=False).ids
    assert list(Encoder.of(tokenizer_path(name)).encode([text, None])) == [np.array(want, "<u4").tobytes(), b""]


@pytest.mark.parametrize(("name", "special"), [(BYTE_BPE, 50256), (WORD_BPE, 49407)])
def test_added_tokens_are_the_library_s(name, special):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|ENDOFTEXT|>b", "plain words", "<|startoftext|>x <|endoftext|>\n<|endoftext|>", "a <| b |> c"]
    found = [np.frombuffer(x, "<u4").tolist() for x in Encoder.of(tokenizer_path(name)).encode(texts)]
    assert found == [plain(name).encode(t, add_special_tokens=False).ids for t in texts] and special in found[0]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_texts_encoded_side_by_side(name, monkeypatch):
    """Prompts and texts share an encoder: one of them empties the memo while the other is still giving its ids."""
    monkeypatch.setattr(tokens, "SLICE", 4)
    monkeypatch.setattr(tokens, "KEEP_CHUNKS", 20)
    rng, encoder = random.Random(4), Encoder(tokenizer_path(name))
    prompts, texts = ([sentence(rng, 10) for _ in range(20)] for _ in range(2))
    for (a, b), *given in zip(zip(encoder.encode(prompts), encoder.encode(texts)), prompts, texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in (a, b)] == [plain(name).encode(t, add_special_tokens=False).ids for t in given]


def test_a_single_word_beyond_ascii():
    for name in (BYTE_BPE, WORD_BPE):
        for words in (["é"], ["é", "a"], ["a", "é"], ["É", "ß"], ["Ab"]):
            want = [np.array(plain(name).encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
            assert Encoder(tokenizer_path(name))._word_ids(words) == want


def pieces_are_whole(rows, limits):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for found in by_sequence.values():
        found.sort(key=lambda r: r["offset"])
        at = 0
        for r in found:
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(found) <= limits.segments and sum(r["loss_tokens"] for r in found) <= limits.loss_tokens
    return by_doc, by_sequence


def test_packing(spark, odd):
    rng = random.Random(0)
    texts = [sentence(rng, rng.choice([1, 5, 40, 300, 900])) for _ in range(120)]
    rows = packing.pack(docs(spark, texts), tokenizer_path(BYTE_BPE), 0, block=16).collect()
    by_doc, by_sequence = pieces_are_whole(rows, packing.Limits())
    lengths = [sum(r["length"] for r in s) for s in by_sequence.values()]
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths) < 0.02 * sum(lengths)
    e = plain(BYTE_BPE)
    for i, t in enumerate(texts):
        ids = np.array([*e.encode(t, add_special_tokens=False).ids, 0], "<u4")
        found = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in found] == [0, *np.cumsum([r["length"] for r in found])[:-1]] and sum(r["length"] for r in found) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in found)
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(odd, tokenizer_path(BYTE_BPE), 0).collect()}
    assert got[1] == got[2] == 1 and set(got) == {None, 1, 2, 3, 4, 5}
    assert packing.pack(odd.limit(0), tokenizer_path(BYTE_BPE), 0).collect() == []


def test_packing_under_three_limits(spark):
    """Conversations: prompts bear no loss; segments and loss run out before tokens."""
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.choice([2, 30, 80])), sentence(rng, rng.choice([1, 60]))) for i in range(80)]
    limits = packing.Limits(tokens=256, segments=3, loss_tokens=100)
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, prompt string"), tokenizer_path(BYTE_BPE), 0, limits, prompt_col="prompt", block=10).collect()
    by_doc, _ = pieces_are_whole(found, limits)
    assert all(sum(r["length"] for r in v) == v[0]["doc_tokens"] for v in by_doc.values()) and len(by_doc) == 80


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 40_000), st.integers(0, 2**32 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    a = np.array(ids, "<u4")
    words, escapes = token_files.encode(a)
    assert (token_files.decode(words, escapes) == a).all()


def test_simple8b_takes_the_most_ids_a_word():
    """The selectors are those of a plain greedy walk; widths come from a table that holds every value up to the escape."""
    assert token_files._WIDTH.tolist() == [v.bit_length() for v in range(token_files.ESCAPE + 1)]
    rng = random.Random(5)
    a = [rng.randrange(rng.choice([1, 2, 9, 300, 40_000])) if rng.random() < 0.1 else 0 for _ in range(3000)] + [rng.randrange(40_000) for _ in range(500)]
    want, i = [], 0
    while i < len(a):
        want.append(next(s for s, (c, b) in enumerate(zip(token_files.COUNTS, token_files.BITS)) if i + c <= len(a) and all(min(v, token_files.ESCAPE) < 1 << b for v in a[i : i + c])))
        i += token_files.COUNTS[want[-1]]
    words, _ = token_files.encode(np.array(a, "<u4"))
    assert (np.frombuffer(words, "<u8") >> np.uint64(60)).tolist() == want


def test_token_files(spark, odd, tmp_path):
    rng = random.Random(2)
    texts = [sentence(rng, rng.choice([1, 50, 4000])) for _ in range(60)]
    shuffled = docs(spark, texts).orderBy(F.rand(1)).repartition(5)
    token_files.write_ids(shuffled, str(tmp_path / "a"), tokenizer_path(WORD_BPE), 2)
    got = sorted(token_files.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r["doc_id"])
    e, start = plain(WORD_BPE), 0
    for r, t in zip(got, texts, strict=True):
        ids = np.array([*e.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids) // 4, ids)
        start += len(ids) // 4
    token_files.write_ids(odd, str(tmp_path / "b"), tokenizer_path(WORD_BPE), 2)
    assert {r["doc_id"]: r["n_tokens"] for r in token_files.read_ids(spark, str(tmp_path / "b")).collect()}[1] == 1
    token_files.write_ids(odd.limit(0), str(tmp_path / "c"), tokenizer_path(WORD_BPE), 2)
    assert token_files.read_ids(spark, str(tmp_path / "c")).collect() == []


def test_token_files_split_a_hot_id(spark, tmp_path):
    """Rows without an id and rows that are equal go to several parts, and still each is there once, gapless."""
    rows = [(None, f"word {i}") for i in range(300)] + [(7, "the same")] * 300 + [(i, "other") for i in range(8, 308)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one part
    try:
        token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), tokenizer_path(WORD_BPE), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(str(tmp_path / "a")).select("part", F.explode("doc_ids").alias("id"))
    assert min(r["n"] for r in parts.filter("id is null or id = 7").groupBy("id").agg(F.countDistinct("part").alias("n")).collect()) > 1
    got = sorted(token_files.read_ids(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(-1 if i is None else i for i, _ in rows)
    e = plain(WORD_BPE)
    want = sorted(np.array([*e.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)
    assert sorted(bytes(r["ids"]) for r in got) == want


# Personal data


def patterns(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1234567890.. -+@@()😀é\n4")), max_size=60))
def test_base_spans_are_the_patterns(text):
    assert [(s, pii.KINDS.index(k), e) for s, e, k in pii.spans(text) if k in pii.BASE_KINDS] == patterns(text)


def test_pii(spark, odd):
    text = "Write to Ann.Lee@mail.example.com, see https://example.org/a?b=1. Account number: DE44500105175407324931! 4012888888881881 +1 (212) 555-0199, 1.2.3.400, 10.0.0.1 and http://no"
    shown = {k: text[s:e] for s, e, k in pii.spans(text)}
    assert shown == {
        "email": "Ann.Lee@mail.example.com", "url": "https://example.org/a?b=1", "account": "DE44500105175407324931", "card": "4012888888881881", "phone": "+1 (212) 555-0199", "ip": "10.0.0.1",
    }
    found = lambda t: [(k, t[s:e]) for s, e, k in pii.spans(t) if k not in pii.BASE_KINDS]
    secret = "0123456789abcdef0123456789abcdef01234567"
    assert found(f'x token = "{secret}" y API_KEY={secret}; password is hunter22.') == [("secret", secret), ("secret", secret), ("secret", "hunter22")]
    assert found("user_id=ab12345, SSN 123-45-6789. IBAN DE44 5001 0517 5407 3249 31 and account 1234567890") == [("account", x) for x in ("ab12345", "123-45-6789", "DE44 5001 0517 5407 3249 31", "1234567890")]
    assert found("HTTPS://Example.ORG/x İ Account: 123456") == [("url", "HTTPS://Example.ORG/x"), ("account", "123456")]
    assert found("the token of the secret account is here, tokens 12345678, password: short, account in 2026, IBAN DE45 5001 0517 5407 3249 31") == []
    rows = {r["doc_id"]: r for r in pii.find_pii(odd).collect()}
    assert rows[1]["spans"] == "" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(rows) == 6
    assert pii.find_pii(odd.limit(0)).collect() == []
    assert pii.spans("1" * 200_000 + "." * 1000 + "@" * 1000) == []


# Near-duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(texts, percent=85):
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return [min(k for k, x in enumerate(label) if x == y) for y in label], [len(s) for s in sets]


def test_near_duplicates(spark, odd):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = sentence(rng, 120).split(" ")
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 2, 3, 4, 6, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            texts.append(" ".join(w).upper() if edits == 1 else "\n".join(w))
    texts += ["one two", "One  two", "", "  ", "one two three", sentence(rng, 3000)]
    rng.shuffle(texts)
    want, sizes = brute_components(texts)
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want and [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == 7 and {r["doc_id"]: r["n_shingles"] for r in rows}[1] == 0
    assert near_duplicates.near_duplicates(odd.limit(0)).collect() == []
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5]


def edited(text, *at):
    w = text.split(" ")
    for i in at:
        w[i] = f"edit{i}"
    return " ".join(w)


def test_near_duplicates_of_ids_with_several_texts(spark):
    """Two null ids and an id with two texts: each text is near another document, or has many words of its own."""
    rng = random.Random(13)
    a, b, c, d, e = (sentence(rng, n) for n in (104, 110, 120, 130, 5000))
    rows = [(7, a), (None, edited(a, 50)), (None, e), (20, b), (21, c), (22, edited(b, 40)), (22, edited(c, 60)), (30, d), (31, edited(d, 9)), (32, sentence(rng, 100))]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == [(7, 7), (20, 20), (21, 20), (22, 20), (22, 20), (30, 30), (31, 30), (32, 32)]
    assert {(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None} == {(7, False), (None, True)}


def brute_named(rows, percent=85):
    """component_id of each row: rows are nodes, linked by text or by an id that both have."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near = sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if (near or (rows[i][0] is not None and rows[i][0] == rows[j][0])) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return [min((rows[k][0] for k, x in enumerate(label) if x == y and rows[k][0] is not None), default=None) for y in label]


def test_null_ids_are_nodes_of_their_own(spark):
    """Rows without an id link what is near them and nothing else, also beside real ids -1 and 0."""
    rng = random.Random(31)
    a, b, c, d = (sentence(rng, 100) for _ in range(4))
    rows = [(None, a), (7, edited(a, 50)), (None, b), (9, edited(b, 50)), (-1, c), (0, d), (None, edited(c, 9)), (None, sentence(rng, 60)), (None, None), (None, ""), (11, None)]
    for _ in range(40):
        base = rng.choice([a, b, c, d, sentence(rng, 70)])
        rows.append((rng.choice([None, None, -1, 0, 7, *range(12, 30)]), edited(base, *rng.sample(range(60), rng.randrange(4)))))
    rows += [rows[0], rows[1], rows[2]]
    want = brute_named(rows)
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: tuple((y is not None, y or 0) for y in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key) == sorted(((i, len(shingle_set(t)), w) for (i, t), w in zip(rows, want)), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    stay = {(i, t) for (i, t), w in zip(rows, want) if i == w}
    assert {tuple(r) for r in kept} == stay and sum(r[0] is not None for r in kept) == sum(i is not None for i, _ in stay)


def test_pipeline_s_near_duplicates_begin_at_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(14)
    bases = [sentence(rng, 120) for _ in range(15)]
    pairs = [t for base in bases for t in (base, edited(base, 30, 70))]  # 106 of 126 shingles
    kept = corpus_pipeline.one_of_each_group(spark, docs(spark, pairs), "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 30, 2))


@pytest.mark.parametrize("t", [168, 200, 512])
def test_filled_coordinates_stay(t):
    """Each coordinate of a small set has the value of the first round that fills it."""
    rng = np.random.default_rng(15)
    for n in range(1, 9):
        s = np.sort(sketches.mix(rng.integers(0, 2**63, n).astype(np.uint64)))
        got = sketches.sketches([s], t)[0]
        want = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        for i in range(2 * t):
            z = sketches.mix(s ^ sketches.mix(np.array([i + 1], np.uint64) * np.uint64(sketches._BASE)))
            bins = ((z >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(int) if i < t else np.full(n, i - t)
            for at in np.unique(bins):
                if want[at] == np.iinfo(np.uint64).max:
                    want[at] = got[at]
                    value = (sketches.mix(z[bins == at]) >> np.uint64(10)).min()
                    assert got[at] & np.uint64((1 << 54) - 1) == value and got[at] >> np.uint64(54) == i


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = sketches.mix(rng.integers(0, 2**63, 1400).astype(np.uint64))
    a, b = np.sort(pool[:1000]), np.sort(pool[400:])
    small = np.sort(pool[:3])
    s = sketches.sketches([a, b, small], 512)
    assert (s != np.iinfo(np.uint64).max).all()  # every coordinate is filled, also of three elements
    assert abs((s[0] == s[1]).mean() - 600 / 1400) < 0.08


# Decontamination


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            window = w[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("window_bytes", "segment"), [(32 << 20, 1000), (3000, 7)])
def test_decontamination(spark, odd, monkeypatch, window_bytes, segment):
    """The second time in several blocks, of segments shorter than items."""
    monkeypatch.setattr(decontamination, "WINDOW_BYTES", window_bytes)
    monkeypatch.setattr(decontamination, "SEGMENT", segment)
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice([1, 2, 9, 10, 11, 30]))) for i in range(30)] + [(30, "é ß"), (31, ""), (32, None), (33, items_text := sentence(rng, 12)), (34, items_text)]
    texts = []
    for i in range(40):
        parts = [sentence(rng, 20), rng.choice(items)[1] or "", sentence(rng, 5), " ".join((rng.choice(items)[1] or "").split()[2:14]), "É ß é-ß"]
        texts.append("\n ".join(rng.sample(parts, 4)).upper() if i % 3 == 0 else "--".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in decontamination.digest(decontamination.find_overlaps(docs(spark, texts), bench)).collect()}
    assert rows == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert len(decontamination.find_overlaps(odd, bench).collect()) == 7
    assert decontamination.find_overlaps(odd, bench.limit(0)).filter(F.size("hits") > 0).count() == 0
    clean = decontamination.drop_contaminated(docs(spark, [*texts, "clean words only"]), bench)
    assert clean.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and "clean words only" in [r["text"] for r in clean.collect()]


# Line dedup


def test_line_dedup(spark, odd):
    rng = random.Random(5)
    passage = " ".join(sentence(rng, 12) for _ in range(6))
    one_line = " ".join(sentence(rng, 1)[:-1] for _ in range(60))
    short = sentence(rng, 20)
    texts = [
        f"{sentence(rng, 9)} {passage}\n{short}\nend one", f"{sentence(rng, 7)}\n{passage}\nmiddle. {short}\nend two", f"lead {sentence(rng, 6)} {passage} tail", f"{one_line}\nx", f"y\n{one_line}\nz",
        "\n".join([sentence(random.Random(9), 10)] * 40), sentence(rng, 80), "w " + sentence(rng, 5),
    ]
    texts.append(texts[6])
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_runs(docs(spark, texts)).collect()}
    assert [got[i]["text"] == t for i, t in enumerate(texts)] == [True, False, False, True, False, False, True, True, False]
    assert passage not in got[1]["text"] and short in got[1]["text"] and got[1]["text"].endswith("end two") and passage[:60] not in got[2]["text"]
    assert got[4]["text"] == "y\nz" and got[8]["text"] == "" and got[5]["text"].count("\n") < 8
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    kept = line_dedup.without_emptied(line_dedup.drop_repeated_runs(docs(spark, texts)))
    assert {r["doc_id"] for r in kept.collect()} == set(range(8)) and "lines_dropped" not in kept.columns
    same = line_dedup.drop_repeated_runs(odd)
    assert sorted(map(str, [r["text"] for r in same.collect()]), key=len)[:3] == sorted(["None", "", "  \n "], key=len) and same.count() == 7
    assert line_dedup.drop_repeated_runs(odd.limit(0)).collect() == []


def brute_runs(texts, min_words=50):
    """Indices of the lines of each text that go: those in a run of min_words or more that occurred before."""
    split = [[x for x in re.split(r"(?<=\n)|(?<=[.!?] )", t)] for t in texts]
    bare, seen, gone = [[x.strip(" \n") for x in s] for s in split], set(), []
    for lines in bare:
        words, out = [len(x.split(" ")) if x else 0 for x in lines], set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(words[i:j]) >= min_words and words[i] and words[j - 1]:
                    run = tuple(lines[i:j])
                    if run in seen:
                        out |= set(range(i, j))
                    seen.add(run)
        gone.append(out)
    return ["".join(x for i, x in enumerate(s) if i not in out) for s, out in zip(split, gone)]


def test_line_dedup_finds_every_repeat(spark):
    """Lines of a small pool, so that parts of a repeated run have occurred before, elsewhere and with other neighbours."""
    rng = random.Random(11)
    a, b = sentence(rng, 30), sentence(rng, 22)
    texts = [a + "\n" + sentence(rng, 9), f"{a} {b} {sentence(rng, 9)}", f"{a} {b} {sentence(rng, 8)}"]
    pool = [sentence(rng, n) for n in (1, 2, 3, 5, 8, 13, 20, 24, 25, 30, 49, 55)]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 16))) for _ in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_runs(docs(spark, texts)).collect()}
    assert b in got[1] and a not in got[2] and b not in got[2]
    assert [got[i] for i in range(len(texts))] == brute_runs(texts)


def test_line_dedup_of_null_ids_and_planted_runs(spark):
    """Texts without an id are compared too; all planted runs of 50 to 90 words go but the first of each."""
    rng = random.Random(16)
    runs = ["\n".join(sentence(rng, rng.choice([5, 9, 14])) for _ in range(9)) for _ in range(8)]
    texts = [f"{sentence(rng, 8)}\n{rng.choice(runs)} {sentence(rng, 7)}" for _ in range(80)]
    rows = [(None if i < 20 else i, t) for i, t in enumerate(texts)]
    got = [r["text"] for r in line_dedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [sum(run in t for t in got) for run in runs] == [1] * len(runs) and len(got) == 80


def test_line_dedup_counts_no_blank_lines(spark):
    """One-word lines with blank lines between; each repeated block has far more lines than words."""
    rng = random.Random(12)
    block = "\n\n\n".join(f"item{rng.randrange(10**6)}" for _ in range(70))
    few = "\n\n\n\n".join(f"item{rng.randrange(10**6)}" for _ in range(49))
    texts = [f"one\n{block}\n{few}\nx", f"two\n\n{block}\nend", f"three\n{few}\nend", "\n\n", block]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_runs(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_runs(texts) == [texts[0], "two\n\nend", texts[2], texts[3], ""]


# Sharding


def test_sharding(spark, odd):
    rng = random.Random(6)
    texts = [sentence(rng, rng.choice([1, 5, 50])) for _ in range(600)] + ["a copy with a third of all rows"] * 300
    rows = sharding.shard_documents(docs(spark, texts), 8).collect()
    total, groups = sum(r["size"] for r in rows), {}
    for r in rows:
        groups.setdefault(r["shard"], []).append(r)
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert sorted(r["doc_id"] for r in rows) == list(range(900)) and set(groups) == set(range(8))
    for found in groups.values():
        assert sorted(r["slot"] for r in found) == list(range(len(found))) and abs(sum(r["size"] for r in found) - total / 8) <= max(r["size"] for r in rows)
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 7 and {r["doc_id"]: r["size"] for r in rows}[1] == 1
    assert sharding.shard_documents(odd.limit(0)).collect() == []


def test_shards_of_many_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "ROWS", 5)
    rng = random.Random(7)
    texts = [sentence(rng, rng.choice([1, 5, 50])) for _ in range(2000)] + ["a copy"] * 1000
    table = docs(spark, texts)
    placed = sharding.shard_documents(table, 4).cache()
    rows = placed.collect()
    sizes = {i: sum(r["size"] for r in rows if r["shard"] == i) for i in range(4)}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in rows if r["shard"] == i) == list(range(sum(r["shard"] == i for r in rows))) for i in range(4))
    sharding.write_shards(table, placed, f"{tmp_path}/shards")
    again = spark.read.parquet(f"{tmp_path}/shards").select("doc_id", "text", "shard").collect()
    assert {(r["doc_id"], r["text"], r["shard"]) for r in again} == {(r["doc_id"], texts[r["doc_id"]], r["shard"]) for r in rows} and len(again) == 3000


def test_shards_keep_groups_whole(spark):
    """Groups that fit are in one shard, larger ones in as few as can take them, and shards are nearly equal."""
    rng = random.Random(17)
    texts = [sentence(rng, rng.choice([1, 5, 30])) for _ in range(1500)]
    for n, size in ((900, 30), (300, 20), (120, 10), (40, 5), (7, 40), (2, 60)):
        texts += [sentence(rng, size)] * n
    texts += [""] * 2000 + texts[:200]
    rng.shuffle(texts)
    rows = sharding.shard_documents(docs(spark, texts), 8).collect()
    share, of, size = sum(r["size"] for r in rows) / 8, {}, {}
    for r in rows:
        of.setdefault(texts[r["doc_id"]], {}).setdefault(r["shard"], 0)
        of[texts[r["doc_id"]]][r["shard"]] += r["size"]
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert all(len(found) == 1 for found in of.values() if sum(found.values()) < share / 16)
    assert sum(len(found) > 1 for found in of.values()) <= 2 and all(len(found) <= 2 + sum(found.values()) / share for found in of.values())
    assert all(abs(s - share) <= share / 16 + max(r["size"] for r in rows) for s in size.values())
    assert all(sorted(r["slot"] for r in rows if r["shard"] == i) == list(range(sum(r["shard"] == i for r in rows))) for i in range(8))


def test_large_groups_are_given_places():
    places, taken = sharding.given_places({1: 50, 2: 250, 3: 60, 4: 40}, 100, 4)
    assert places[3] == [(60, 3)] or len(places[3]) == 1
    assert sum(taken) == 400 and max(taken) == 100 and [e for e, _ in places[2]] == [100, 200, 250]


def test_ranges_split_rows_of_one_text_without_ids(spark, monkeypatch):
    """A third of the rows share text and have no id: no range holds more than its share of them."""
    monkeypatch.setattr(sharding, "cut", lambda df: seen.append(df) or tables.cut(df))
    seen = []
    rng = random.Random(18)
    rows = [(None, "one text of many")] * 5000 + [(i, sentence(rng, 4)) for i in range(10_000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(found) == 15_000 and max(r[1] for r in seen[-1].groupBy("_range").count().collect()) < 15_000 / 64 * 4


# Exact top-k


def brute_top(rows, k=5):
    ok = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(top_k, "TILE", 37)
    monkeypatch.setattr(top_k, "BLOCK_BYTES", 200)
    monkeypatch.setattr(top_k, "SHARD_BYTES", 9000)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(400)]
    rows = [(i, rows[3][1] if i % 3 == 0 else v) for i, v in rows] + [(450, [1e30] * 8), (451, None), (452, [1.0, None] * 4), (453, [float("nan")] * 8), (500, [1.0, 2.0]), (501, [1.0, -2.0]), (None, [1.0] * 8)]
    rows = [r for r in rows if r[0] != 450]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    assert {tuple(r) for r in top_k.top_k(v.filter("vec_id % 50 = 0"), v).collect()} == brute_top(rows)
    assert top_k.top_k(v.limit(0), v).collect() == [] and top_k.top_k(v, v.limit(0)).collect() == []


def test_tiles_of_a_shard(monkeypatch):
    rng = np.random.default_rng(17)
    table = lambda ids: pa.table({"vec_id": pa.array(ids, pa.int64()), "v": pa.array(rng.integers(-2, 3, (len(ids), 3)).astype(float).tolist(), pa.list_(pa.float64()))})
    q, c = table([3, 50, 900]), table(rng.permutation(200))
    whole = top_k._search(q, c, 5)
    monkeypatch.setattr(top_k, "TILE", 40)
    assert top_k._search(q, c, 5).equals(whole) and whole.num_rows == 15
    assert top_k._search(q, c.slice(0, 0), 5).num_rows == top_k._search(q.slice(0, 0), c, 5).num_rows == 0


def test_top_k_beyond_doubles():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0], [2.0**60, 0.0]])
    assert top_k._products(q, c).tolist() == [[2**60 + 1, 2**60 + 2, 2**63 - 1]]


# Classifiers: held-out accuracy


@pytest.fixture(scope="module")
def sf(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


def test_quality(spark, sf, odd):
    d, labels = sf
    rows = quality.quality_scores(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.97
    assert (rows.predicted == rows.quality).mean() > 0.9
    few = quality.quality_scores(odd, labels).collect()
    assert len(few) == 7 and all(0 <= r["score"] <= 1 for r in few)
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(odd.limit(0), labels).collect() == []
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and 0.5 * d.count() < kept.count() < d.count()


def test_samples_are_bounded_without_ids(spark, monkeypatch):
    """Rows without an id, or with one id, are drawn one by one: the driver sees neither all of them nor none."""
    monkeypatch.setattr(quality, "SAMPLE", 200)
    monkeypatch.setattr(language, "SAMPLE", 200)
    rng, seen = random.Random(21), []
    texts = [sentence(rng, 8) for _ in range(2000)]
    monkeypatch.setattr(language, "Languages", lambda x, lang: seen.append(len(x)))
    for doc_id in (None, 1):
        d = docs(spark, [(doc_id, t, "en", "s", 1) for t in texts])
        rows = d.select("doc_id", "text").withColumn("at", F.monotonically_increasing_id())
        seen += [len(quality._sample(rows, 2000, 1)), len(quality._sample(rows, 2000, 2))]
        language._fit(d)
    assert len(seen) == 6 and all(100 < n < 300 for n in seen)


def test_positives_are_drawn_by_id(spark, monkeypatch):
    """Of many trusted ids about twice SAMPLE are drawn, with all their rows; null ids are nobody's."""
    monkeypatch.setattr(quality, "SAMPLE", 100)
    ids = spark.createDataFrame([(i % 1500,) for i in range(3000)] + [(None,)] * 5, "doc_id long")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in range(1200)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    found, n = quality._positives(ids, labels)
    got = {r[0] for r in found.collect()}
    assert 120 < len(got) < 280 and got <= set(range(1000)) and n == 2 * len(got)
    found, n = quality._positives(ids, labels.filter("doc_id < 50"))
    assert {r[0] for r in found.collect()} == set(range(50)) and n == 100


def test_slices_are_bounded_by_bytes():
    texts = ["a" * 400, None, "", "b" * 5000, "é" * 200, *["c"] * 40]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(slices.by_bytes(iter([b, b.slice(0, 0)]), 1, limit=1000))
    assert [t for x in got for t in x.column(1).to_pylist()] == texts and max(x.num_rows for x in got) <= 16
    assert all(x.num_rows == 1 or sum(len((t or "").encode()) for t in x.column(1).to_pylist()) <= 1000 for x in got)


def two_classes(rng, n):
    return rng.normal(0, 1, (n, quality.INPUTS)), np.concatenate([rng.normal(3, 1, (n, quality.MEASURES)), rng.normal(0, 1, (n, quality.GRAMS))], axis=1)


def test_prior_is_estimated():
    good, bad = two_classes(np.random.default_rng(8), 9000)
    unlabelled = np.concatenate([good[:3500], bad[:1500]])
    net = quality.fit(good[4000:6000], unlabelled[::2], 0.5)
    assert abs(quality.estimated_prior(net, good[6000:8000], unlabelled[1::2]) - 0.7) < 0.08  # of rows that the network hasn't seen
    net = quality.fit_with_prior(good[4000:8000], unlabelled)
    s = quality.scores(net, np.concatenate([good[8000:], bad[8000:]]))
    assert (s[:1000] >= 0.3).mean() > 0.97 and (s[1000:] < 0.3).mean() > 0.97


def test_slopes_are_those_of_the_output():
    good, bad = two_classes(np.random.default_rng(9), 30)
    net, to_output = quality.Network(np.concatenate([good, bad])), np.random.default_rng(10).normal(size=60)
    x = np.concatenate([good, bad])
    slopes = net.slope(net.inputs(x), to_output)
    for w, g in zip(net.w, slopes):
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            w[at] += 1e-5
            up = (to_output * net(x)).sum()
            w[at] -= 2e-5
            down = (to_output * net(x)).sum()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_inputs_do_not_depend_on_the_batch():
    texts = ["One two two\nthree", None, "", "x", "é ß one two", "a longer text of some words. " * 9]
    whole = quality.inputs_of(texts)
    assert whole.shape == (6, quality.INPUTS) and not whole[1:3].any()
    assert all((quality.inputs_of([t])[0] == row).all() for t, row in zip(texts, whole))
    assert (whole[0] != quality.inputs_of(["One two six\nthree"])[0]).any()


def test_language(spark, sf, odd):
    d, _ = sf
    rows = language.predict_languages(d).filter("held_out").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97
    got = {r["doc_id"]: r for r in language.predict_languages(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predict_languages(odd.limit(0)).collect() == []


# The pipeline


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = d.columns, {r[0] for r in d.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, sf_dir).collect(), d.schema)
        assert d.columns == columns, name
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    assert 0 < len(texts) < len(ids)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    order = sorted(texts)
    assert brute_components([texts[i] for i in order])[0] == list(range(len(order)))  # no near-duplicates are left
    assert not any(brute_hits(texts[i], items)[-1] for i in order[:40])
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in found} == set(texts)
    e = plain(BYTE_BPE)
    total = {}
    for r in found:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(e.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
