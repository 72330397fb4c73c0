import hashlib
import json
import struct
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixframe.llm import bpe, encode, wavelet
from helixframe.llm.common import shared_folder

import public_tokenizers

PATH = public_tokenizers.path("byte_bpe_50k.json")

DEFINITION = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
AUTOMATON = bpe.Automaton(DEFINITION)
ENCODERS = [bpe.TextEncoder(AUTOMATON.encode_words, AUTOMATON.special), bpe.TextEncoder(bpe.library_encoder(DEFINITION), AUTOMATON.special)]
ALPHABET = st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("  \n\t'strevlmd'aehin019.,!|%&é日🙂  ")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=60), st.sampled_from(["<|endoftext|>", "x<|endoftext|> y", ""])), max_size=4))
def test_as_the_library(texts):
    for encoder in ENCODERS:
        ids, ends = encoder.encode(texts)
        for i, t in enumerate(texts):
            own = ids[ends[i] : ends[i + 1]]
            assert own.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids
            assert AUTOMATON.emit(own).decode("utf-8", "replace") == LIBRARY.decode(own.tolist(), skip_special_tokens=False)


def test_small_automaton_by_hand():
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "bc", "ab"])}
    a = bpe.Automaton(json.dumps({"model": {"vocab": vocab, "merges": ["b c", "a b"]}}))
    flat, counts = a.encode_words(["abc", "ab", "aab", "bcb", "a" * 100])
    assert counts.tolist() == [2, 1, 2, 2, 100] and flat[:2].tolist() == [0, 3]
    assert not a.has_arc(np.array([4]), np.array([2]))[0]  # after "ab" no "c": "b c" came first


def test_emptied_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    e = bpe.TextEncoder(AUTOMATON.encode_words, {})
    for t in ("a b c", "d e f g", "a b h i", "j k l m n o p q r"):
        assert e.encode([t])[0].tolist() == LIBRARY.encode(t).ids


def test_portions(monkeypatch):
    """Texts cut into portions, more words than the table has slots, a long word, special tokens."""
    monkeypatch.setattr(bpe, "TABLE_BITS", 10)
    monkeypatch.setattr(bpe, "PORTION", 100)
    texts = [" ".join(f"w{i}" for i in range(3000)), "", "a1b2c3" * 700, " \n\n  x  \t y's" * 60, "ab<|endoftext|> c" * 40, "zqxj" * 300, "日本 語" * 90]
    e = bpe.TextEncoder(AUTOMATON.encode_words, AUTOMATON.special)
    for _ in range(2):
        ids, ends = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert "".join(bpe.cut_at_blanks(texts[0], 50)) == texts[0] and max(map(len, bpe.cut_at_blanks(texts[0], 50))) < 60


def test_long_word():
    """A word of 200,000 letters, which is read byte by byte."""
    import random

    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    assert AUTOMATON.encode_words([word, "x"])[0].tolist() == LIBRARY.encode(word, add_special_tokens=False).ids + LIBRARY.encode("x", add_special_tokens=False).ids


def test_millions_of_words():
    """A text of more distinct words than the table has slots, within bounded memory."""
    import resource

    text = " ".join(map(str, range(2_200_000, 4_500_000)))
    e, before = bpe.TextEncoder(bpe.library_encoder(DEFINITION), {}), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids, ends = e.encode([text])
    assert len(ids) == ends[1] > 2_300_000 and AUTOMATON.emit(ids[-8:].astype(np.int64)).endswith(b"4499999")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


#: Two words of equal polynomial hash modulo 2**64, whatever the base.
THUE = "".join("ab"[i.bit_count() & 1] for i in range(4096))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomial_hash():
    for encoder in ENCODERS:
        for t in (f"{THUE} {MORSE}", MORSE, THUE):
            assert encoder.encode([t])[0].tolist() == LIBRARY.encode(t).ids


def test_words_of_equal_hash(monkeypatch):
    """With a hash of few values words are told apart by their characters."""
    monkeypatch.setattr(bpe, "tiled_hash", lambda points, starts: np.full(len(starts), 7, dtype=np.uint64))
    e = bpe.TextEncoder(AUTOMATON.encode_words, {})
    for t in ("a b c a", "abc abd xyz", "", "b a longer b"):
        assert e.encode([t, t])[0].tolist() == LIBRARY.encode(t).ids * 2


def test_other_tokenizer_files():
    import pytest

    spec = json.loads(DEFINITION)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.Automaton(json.dumps(spec | change))


def gadget_automaton(n_bytes, merges):
    """The written-out automaton: a state with a loop for each byte, then one gadget for each merge.

    All arcs of one label lead to one state. A gadget lays an arc of the new label over each
    arc u whose state has an arc v, and leads the arcs u to a copy of that state without v.
    """
    arcs, label = [{x: 0 for x in range(n_bytes)}], n_bytes
    for u, v in merges:
        behind = {s[u] for s in arcs if u in s}
        assert len(behind) <= 1
        for t in behind:
            if v in arcs[t]:
                after, copy = arcs[t][v], len(arcs)
                arcs.append({x: to for x, to in arcs[t].items() if x != v})
                for s in arcs:
                    if u in s:
                        s[u], s[label] = copy, after
        label += 1
    return arcs


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=4))
def test_as_written_out_gadgets(pairs):
    """The compact automaton accepts the token strings that the merged gadgets accept."""
    import itertools

    names, merges, ids = ["a", "b", "c"], [], []
    for i, j in pairs:
        if i < len(names) and j < len(names) and names[i] + names[j] not in names:
            merges.append(f"{names[i]} {names[j]}"), ids.append((i, j)), names.append(names[i] + names[j])
    own = bpe.Automaton(json.dumps({"model": {"vocab": {n: i for i, n in enumerate(names)}, "merges": merges}}))
    library = Tokenizer.from_str(json.dumps({"version": "1.0", "model": {"type": "BPE", "vocab": {n: i for i, n in enumerate(names)}, "merges": merges}}))
    arcs = gadget_automaton(3, ids)
    for length in range(1, 4):
        for word in itertools.product(range(len(names)), repeat=length):
            state = 0
            for x in word:
                state = arcs[state].get(x) if state is not None else None
            canonical = own.encode_words(["".join(names[x] for x in word)])[0].tolist() == list(word)
            assert (state is not None) == canonical == (library.encode("".join(names[x] for x in word)).ids == list(word))


def test_operator(spark, odd_docs, no_docs, tokenizer_path):
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    found = encode.bpe_round_trip(odd_docs, tokenizer_path).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = encode.bpe_decode(encode.bpe_encode(odd_docs.withColumnRenamed("label", "ids"), tokenizer_path), tokenizer_path)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and "lang" in back.columns
    bare = encode.bpe_encode(odd_docs.select("doc_id", "text"), tokenizer_path, keep_text=False)
    assert bare.columns == ["doc_id", "ids"] and encode.bpe_decode(bare, tokenizer_path).count() == len(texts)
    assert encode.bpe_round_trip(no_docs, tokenizer_path).count() == 0


def test_token_files(spark, odd_docs, no_docs, tokenizer_path, monkeypatch):
    path = shared_folder(spark) + "/tokens-a"
    wavelet.write_token_files(odd_docs, path, tokenizer_path)
    rows = {r.doc_id: r for r in wavelet.read_token_files(spark, path).collect()}
    start = 0
    for doc, text in sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    every = [x for _, text in sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)) for x in [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]]
    asked = [0, 1, len(every) // 2, len(every) - 1, len(every) + 5]
    assert {(r.place, r.id) for r in wavelet.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "place long")).collect()} == {(p, every[p]) for p in asked[:-1]}
    ids = [0, every[5], every[-2], 50255]
    assert sorted((r.id, r.place) for r in wavelet.token_places(spark, path, ids).collect()) == sorted((x, i) for i, x in enumerate(every) if x in ids)
    assert {r.id: r.n for r in wavelet.token_counts(spark, path, ids).collect()} == {i: every.count(i) for i in ids}
    wavelet.write_token_files(no_docs, path + "b", tokenizer_path)
    assert wavelet.read_token_files(spark, path + "b").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700))
def test_wavelet_matrix(values):
    v = np.array(values, dtype=np.uint32)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(v).to_bytes())
    assert w.decode().tolist() == values
    for i in range(0, len(values), 37):
        assert w.access(i) == values[i] and w.rank(values[i], i) == values[:i].count(values[i])
    for symbol in [*values[:3], 299]:
        assert [i for x in w.occurrences(symbol) for i in x.tolist()] == [i for i, x in enumerate(values) if x == symbol] and w.count(symbol) == values.count(symbol)


def test_matrix_cost():
    """Building and decoding take much less CPU than by boolean masks, for the same planes and values."""

    def masks(v):
        planes, zeros = [], []
        for b in range(15, -1, -1):
            one = (v & np.uint16(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little")), zeros.append(len(one) - int(one.sum()))
            v = np.concatenate([v[~one], v[one]])
        return planes, zeros

    def unmasked(planes, zeros, n):
        values = np.zeros(n, dtype=np.uint16)
        for b, (plane, z) in enumerate(zip(planes[::-1], zeros[::-1], strict=True)):
            one = np.unpackbits(plane, count=n, bitorder="little").astype(bool)
            above = np.empty_like(values)
            above[~one], above[one] = values[:z], values[z:] | np.uint16(1 << b)
            values = above
        return values

    def cpu(f):
        best = np.inf
        for _ in range(5):
            t = time.process_time()
            out = f()
            best = min(best, time.process_time() - t)
        return best, out

    ids = (np.random.default_rng(4).pareto(0.6, 1 << 20) * 30).clip(0, 49_999).astype(np.uint32)
    old, (planes, zeros) = cpu(lambda: masks(ids.astype(np.uint16)))
    new, matrix = cpu(lambda: wavelet.WaveletMatrix.build(ids, 16))
    assert zeros == matrix.zeros and all(np.array_equal(a, b) for a, b in zip(planes, matrix.planes, strict=True))
    old_back, values = cpu(lambda: unmasked(planes, zeros, len(ids)))
    new_back, decoded = cpu(matrix.decode)
    assert np.array_equal(values, ids) and np.array_equal(decoded, ids)
    print(f"build {old:.3f} {new:.3f}, decode {old_back:.3f} {new_back:.3f} s of CPU")
    assert new + new_back < 0.8 * (old + old_back)


def test_entry():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {q.split("_")[0] for q in __spark_entry__.queries()}
