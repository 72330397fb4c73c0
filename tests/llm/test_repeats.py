"""Every operator and the pipeline on repeated rows, null ids and columns named like helpers."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import encode, fingerprint, host_rules, jaccard, licenses, mixing, pii, quality, substrings, wavelet
from helixframe.llm.common import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
NAMES = ["__done", "__key", "__copy", "copies", "ids", "features", "row", "copy", "times", "of", "kept", "key", "done", "id", "same", "N", "label", "score", "bucket", "part", "host", "size", "w", "range", "value", "root", "signature"]
A = " ".join(f"w{i}" for i in range(60))
TEXTS = [(1, A, "s"), (1, A, "s"), (1, A, "s"), (2, A + " more", "s"), (None, A, None), (None, A, None), (3, "Released under the MIT License. x@y.org " + A, "t"), (4, None, "t"), (4, None, "t"), (5, "", None), (6, "x y", "t"), (6, "x y", "t"), (7, " ".join(f"v{i % 50}" for i in range(400)), "u"), (7, " ".join(f"v{i % 50}" for i in range(400)), "u")]
rank = lambda d: (d is not None, d or 0)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(d, t, s, "en", len(t or ""), *range(len(NAMES))) for d, t, s in TEXTS]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_tokens(spark, table):
    ids = {t: LIBRARY.encode(t or "", add_special_tokens=False).ids for _, t, _ in TEXTS}
    assert counted(encode.bpe_round_trip(table, PATH), "doc_id", "n_tokens") == Counter((d, len(ids[t])) for d, t, _ in TEXTS)
    coded = encode.bpe_encode(table, PATH, ids="Ids2")
    assert coded.columns == [*table.columns, "Ids2"] and encode.bpe_decode(coded, PATH, ids="Ids2").where("decoded = coalesce(text, '')").count() == len(TEXTS)
    path, start, want = shared_folder(spark) + "/repeats", 0, Counter()
    for d, t, _ in sorted(TEXTS, key=lambda r: (rank(r[0]), r[1] or "")):
        own = [*ids[t], 0]
        want[d, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
        start += len(own)
    wavelet.write_token_files(table, path, PATH)
    assert counted(wavelet.read_token_files(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_texts(spark, table):
    hidden = pii.pseudonymize(table, "k")
    assert hidden.columns == table.columns and counted(hidden, "doc_id", "n_chars") == counted(table, "doc_id", "n_chars")
    assert counted(hidden.where("text like '%x@y.org%'"), "doc_id") == Counter() and hidden.where("text like '%@y.org%'").count() == 1
    words = [(d, (t or "").split()) for d, t, _ in TEXTS]
    rules = counted(host_rules.host_quality(table), "doc_id", "n_words", "n_repeat_words", "base_failed")
    repeats = {7: 400}
    assert rules == Counter((d, len(w), repeats.get(d, 0), len(w) < 50 or repeats.get(d, 0) * 2 > len(w)) for d, w in words)
    found = counted(licenses.scan_licenses(table), "doc_id", "license")
    assert found == Counter((d, "MIT" if d == 3 else None) for d, _, _ in TEXTS)
    seen, want = set(), Counter()
    for d, w in sorted(words, key=lambda r: rank(r[0])):
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone.update(range(i, i + 20))
            seen.add(k)
        want[d, len(w), len(gone)] += 1
    assert counted(substrings.remove_repeats(table), "doc_id", "n_words", "n_removed") == want
    rows = sorted(((d, t or "") for d, t, _ in TEXTS), key=lambda r: (rank(r[0]), r[1]))
    edited = Counter()
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        edited[d, len(t), hashlib.sha256((t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]).encode()).hexdigest()] += 1
    assert counted(fingerprint.edited_likeness(table), "doc_id", "n_chars", "edited_sha256") == edited


def test_groups_and_mixture(spark, table, labels):
    assert counted(jaccard.similarity_classes(table), "doc_id", "n_shingles", "component_id") == Counter((d, *{1: (56, None), 2: (57, None), None: (56, None), 3: (62, None), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (50, 7)}[d]) for d, _, _ in TEXTS)
    one = jaccard.one_of_each(table)
    assert one.columns == table.columns and counted(one, "doc_id") == Counter([(None,), (4,), (5,), (6,), (7,)])
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "source").toArrow())
    plan = mixing.mix_plan(table)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert counted(plan, *columns) == Counter(con.sql(f"select {', '.join(columns)} from ({mixing.PLAN_SQL})").fetchall())
    mixed = mixing.mix(table)
    want = Counter()
    for r in plan.collect():
        want[r.doc_id, r.size] += r.copies
    assert mixed.columns == table.columns and Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect()) == +want
    scored = quality.quality_scores(table, labels)
    assert counted(scored, "doc_id").keys() == {(d,) for d, _, _ in TEXTS} and scored.count() == len(TEXTS) and scored.select("doc_id", "score").distinct().count() == 8
    assert quality.keep_quality(table, labels).columns == table.columns


def test_pipeline(spark, table, labels, tmp_path):
    import corpus_pipeline

    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    got = counted(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "n_tokens")
    sizes = {d: len((t or "").split()) for d, t, _ in TEXTS if d not in (1, 2, 3)}  # the near copies of the null id's text
    assert {d for d, _ in got} <= sizes.keys() and max(got.values()) <= 2
    assert sum(sizes.values()) <= sum(sizes[d] * n for (d, _), n in got.items()) <= 2 * sum(sizes.values())
