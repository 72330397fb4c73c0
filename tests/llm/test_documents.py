import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.llm import fingerprint, host_rules, jaccard, licenses, mixing, pii, quality, substrings
from helixframe.llm.common import scratch
from helixframe.llm.components import components

SMALL = "/root/testdata/sf0.001"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
rank = lambda d: (d is not None, d or 0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def shingles(text, lower=False):
    w = (text or "").encode()
    w = (w.translate(LOW) if lower else w).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows):
    sets = {d: shingles(t, True) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(sets.items(), key=lambda x: rank(x[0]))
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if x and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = sorted((find(a), find(b)), key=rank)
                root[b_] = a_
    return {d: (len(x), find(d)) for d, x in sets.items()}


def test_similarity_classes(spark, docs, odd_docs, no_docs):
    for table in (docs, odd_docs, no_docs):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        found = jaccard.similarity_classes(table).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == classes(rows) and len(found) == len(rows)


def test_blocks_without_partners(spark):
    rows = [(i, f"only {i} here " * (i % 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df).collect()} == classes(rows)
    assert substrings.remove_repeats(df).where("n_removed > n_words").count() == 0


def test_edited_copies(spark):
    """A family around the threshold: each pair by brute force."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    for d in range(150, 220):
        rows.append((d, " ".join(f"t{rng.randrange(5)}" for _ in range(rng.randrange(1, 12)))))
    found = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == classes(rows)


def test_sets_asked_for_narrow_down(spark, monkeypatch):
    """Who stands in no open signature any more isn't read again, and a bound is worked out once."""
    sets = {1: range(100), 2: range(100, 200), 3: [*range(50), *range(100, 150)], 4: [*range(50), *range(150, 200)], 5: range(50, 150), 6: range(1000, 1100)}
    kept = spark.createDataFrame([(d, len(s), [7], list(s)) for d, s in sets.items()], "rep long, n long, signatures array<long>, shingles array<long>")
    seen, own = [], jaccard._linkable

    def linkable(rows, kept, percent):
        found = own(rows, kept, percent)
        seen.append((kept.count(), found.count(), "Join" in found._jdf.queryExecution().executedPlan().toString()))
        return found

    monkeypatch.setattr(jaccard, "_linkable", linkable)
    monkeypatch.setattr(jaccard, "_many_pairs", lambda rows: True)
    with scratch(spark):
        assert jaccard._classes(kept, 80).collect() == []
    assert seen == [(6, 5, False), (5, 5, False)]


def test_components(spark):
    import random

    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in links for x in e}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and all(x in got for e in links for x in e if e[0] != e[1])


def test_substrings(spark, docs, odd_docs, no_docs):
    for table in (docs, odd_docs, no_docs):
        seen, rows = set(), {r.doc_id: r.text or "" for r in table.collect()}
        found = {r.doc_id: r for r in substrings.remove_repeats(table.repartition(4)).collect()}
        assert found.keys() == rows.keys()
        for d in sorted(rows, key=rank):
            w = rows[d].encode().split()
            gone = [False] * len(w)
            for i in range(len(w) - 19):
                k = tuple(w[i : i + 20])
                if k in seen:
                    gone[i : i + 20] = [True] * 20
                seen.add(k)
            r = found[d]
            assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
            assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_matching_statistics():
    """Lengths of the longest earlier match, by brute force, over few different words."""
    import random

    rng = random.Random(5)
    for _ in range(60):
        automaton, before = substrings.SuffixAutomaton(), []
        for _ in range(rng.randrange(1, 7)):
            words = [rng.randrange(3) for _ in range(rng.randrange(14))]
            if before and rng.random() < 0.4:
                words += before[-1][rng.randrange(3) :]
            seen = {tuple(x[i:j]) for x in before for i in range(len(x)) for j in range(i, len(x) + 1)} | {()}
            want = []
            for end in range(1, len(words) + 1):
                want.append(max(n for n in range(end + 1) if tuple(words[end - n : end]) in seen))
                seen |= {tuple(words[i:end]) for i in range(end)}
            assert automaton.feed(words) == want
            before.append(words)


def test_few_words(spark):
    """Passages that overlap themselves and others, over many blocks."""
    import random

    rng = random.Random(2)
    rows = [(d, " ".join(rng.choice(("a", "b")) * rng.randrange(1, 3) for _ in range(rng.randrange(70)))) for d in range(60)] + [(d, "a " * (d % 50)) for d in range(60, 90)]
    seen, found = set(), {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), length=6).collect()}
    for d, text in rows:
        w, gone = text.split(), set()
        for i in range(len(w) - 5):
            if tuple(w[i : i + 6]) in seen:
                gone.update(range(i, i + 6))
            seen.add(tuple(w[i : i + 6]))
        assert found[d] == len(gone)


def test_fingerprints(spark, docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda r: rank(r[0]))
        found = {r.doc_id: r for r in fingerprint.edited_likeness(table).collect()}
        assert len(found) == len(rows)
        for i, (d, t) in enumerate(rows):
            after, h = rows[(i + 1) % len(rows)][1], len(t) // 2
            edited = t[: len(t) - h] + after[:h]
            r = found[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            a, b = shingles(t), shingles(edited)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r.near_edited - true) < (0.25 if len(a | b) > fingerprint.K else 1e-9)
            assert abs(r.n_shingles - len(a)) <= 0.4 * len(a)
    assert fingerprint.edited_likeness(no_docs).count() == 0
    both = {r.doc_id: r.fingerprint for r in fingerprint.document_fingerprints(odd_docs).collect()}
    assert both[1] == both[5] and both[7] == both[8] != both[1]
    import pyarrow as pa

    x, y = fingerprint.sketches(pa.array(["a b c d e f g", "c d e f g h i"]))
    assert fingerprint.merge(x, y).tolist() == sorted({*x.tolist(), *y.tolist()}) and fingerprint.containment(x, x) == 1.0


def test_rules_and_mix_as_sql(spark, docs, odd_docs, no_docs):
    for table in (docs, odd_docs.where("doc_id is null or doc_id not in (11, 12, 13)")):
        documents = table.toPandas()  # noqa: F841
        for df, sql in ((host_rules.host_quality(table).drop("host_rate"), host_rules.QUALITY_SQL), (mixing.mix_plan(table).drop("copies"), mixing.PLAN_SQL)):
            con = duckdb.connect()
            con.register("documents", table.toArrow())
            columns = sorted(df.columns)
            assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == sorted(str(r) for r in con.sql(f"select {', '.join(columns)} from ({sql})").fetchall())
    # long texts, on which the SQL is slow: all words distinct, and the first ten again at the end
    long = {r.doc_id: r for r in host_rules.host_quality(odd_docs).where("doc_id in (11, 12)").collect()}
    assert (long[11].n_words, long[11].n_repeat_words, long[12].n_words, long[12].n_repeat_words) == (30000, 0, 30000, 20)
    assert host_rules.host_quality(no_docs).count() == 0 and mixing.mix_plan(no_docs).count() == 0


def test_mix(spark, docs):
    plan = mixing.mix_plan(docs).collect()
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6 for r in plan)
    assert abs(sum({(r.source_size, r.target) for r in plan} and {r.source_size: r.target for r in plan}.values()) - 1.5 * sum(r.size for r in plan)) < 1e-3 * sum(r.size for r in plan)
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert got == Counter({r.doc_id: r.copies for r in plan if r.copies}) and mixing.mix(docs).columns == docs.columns
    assert plan == mixing.mix_plan(docs).collect() or sorted(plan) == sorted(mixing.mix_plan(docs).collect())


def test_classifier(spark, docs, odd_docs, no_docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.quality_scores(big, labels)
    held = scored.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.95 * held.count() > 0
    assert scored.where("held_out = (crc32(cast(doc_id as string)) % 3 = 1)").count() == big.count()
    odd = quality.quality_scores(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert quality.quality_scores(no_docs, labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    # labels of held-out rows are never learnt from
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(scored.collect()) == sorted(quality.quality_scores(big, wrong).collect())


def test_licenses(spark, odd_docs, no_docs):
    rows = [(1, "a\nReleased under the MIT License.\nb"), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (5, "he lost his driving licence"), (6, None), (7, ""), (8, "Licensed under the apache license, version 2.0"), (9, "Copyright notices are dull reading")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 10)] == ["MIT", "GPL-2.0", "GPL-3.0", "MIT", None, None, None, "Apache-2.0", None]
    assert got[4].licenses == "CC-BY-NC-4.0,MIT" and got[5].n_blocks == 1 and got[1].n_different == 0
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(no_docs).count() == 0


def test_license_wordings(spark):
    kept = {"All rights reserved.": "Proprietary", "Licensed under the MIT License.": "MIT", "Copyright (c) 2024 X. All rights reserved.": "Proprietary", "Released under the Apache License 2.0": "Apache-2.0", "Licenced under CC BY-SA 4": "CC-BY-SA-4.0"}
    other = ["Some rights reserved.", "all rights are not reserved", "Released under the MIT Press.", "Licensed under CC BY 3.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Apache License, Version 1.1.", "Released under the BSD 4-Clause License.", "Not released under the MIT License.", "This work is not licensed under the GNU General Public License, version 2.", "This work isn't licensed under the GNU General Public License, version 3.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under the GNU General Public License, version 1.", "This work is licensed under the GNU Lesser General Public License, version 2.1."]
    rows = [*kept, *other, *(t for _, t in licenses.TEMPLATES)]
    got = {r.doc_id: r.license for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [*kept.values(), *[None] * len(other), *(name for name, _ in licenses.TEMPLATES)]
    # every line of the documents that speaks of rights is a notice
    found = licenses.scan_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_blocks > 0").collect()
    assert found and all(r.n_confirmed == r.n_blocks for r in found)


ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
FORMS = {
    "SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: CC-BY-SA-4.0\nx": "CC-BY-SA-4.0", "MIT License": "MIT", "see\n  MIT License  \nCopyright": "MIT", "the MIT License applies": None, "Licensed under GPLv3.": "GPL-3.0",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n": "GPL-2.0", ISC: "ISC", "This is free and unencumbered software released into the public domain.": "Unlicense",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at": "EPL-2.0", "https://creativecommons.org/licenses/by/4.0/": "CC-BY-4.0", "https://creativecommons.org/licenses/by-nc/4.0/": "CC-BY-NC-4.0",
    "l\u0131censed under the M\u0130T licence": None,
}


def test_license_forms():
    for text, want in FORMS.items():
        assert [n for n, _, _ in licenses.notices(text)[1]] == ([want] if want else []), text


def test_ranking_loses_no_notice(spark):
    """Against every template compared by wording alone, without compression: the smallest share of different words wins."""
    import bisect

    given = licenses._of(licenses.TEMPLATES, licenses.TITLES)

    def plain(text):
        t, out = licenses._Text(text), []
        for m in licenses.CANDIDATE.finditer(text):
            at = max(0, bisect.bisect_right(t.starts, m.start()) - 1)
            found = [] if t.taken[at] else [f for i in range(len(given.wordings)) if (f := licenses.notice_at(t, at, given, lambda block: [i]))]
            if found:
                a, b, i, different = min(found, key=lambda f: (f[3] / len(given.wordings[f[2]].words), -given.saved(t.passage(f[0], f[1]).casefold().encode(), f[2])))
                t.taken[a:b] = b"\1" * (b - a)
                out.append((a, given.names[i], different))
        return [x[1:] for x in sorted(out)]

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [*FORMS, *(t for _, t in licenses.TEMPLATES)]
    assert sum(len(plain(t)) for t in texts) > 50
    for t in texts:
        assert [(n, d) for n, _, d in licenses.notices(t)[1]] == plain(t)


def test_compression_decides():
    """A template that saves too little in a block isn't compared; without any saving there is no notice."""
    given = licenses._of(licenses.TEMPLATES, licenses.TITLES)
    names = lambda block: [given.names[i] for i in given.ranked(block)]
    assert names("some words. Released under the MIT License. more words")[0] == "MIT" and names("nothing of the kind stands here") == []
    assert len(names("This work is licensed under the GNU General Public License, version 3.")) < len(given.names)


def test_license_places(spark):
    many = " ".join(f"w{i}rd" for i in range(20_000))
    rows = {
        f"{many} Released under the MIT License. {many}": "MIT",
        f"{many} Licensed under CC BY-NC 4.0. {many}\n": "CC-BY-NC-4.0",
        "RELEASED UNDER THE MIT LICENSE.": "MIT",
        "Released under the MIT License. Docs: Licensed under CC BY 4.0.": "CC-BY-4.0,MIT",
        "# This work is licensed under the GNU\n# General Public License,\n# version 3. All rights\n# reserved.": "GPL-3.0,Proprietary",
        "they released it under the sea, licensed or not. Released under the MIT License": "MIT",
        f"{many} licence {many}": "",
        "Released under the MIT License. " * 500: "MIT",
    }
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(len(rows))] == list(rows.values())
    assert [got[i].n_confirmed for i in range(len(rows))] == [1, 1, 1, 2, 2, 1, 0, 500] and all(r.saved > 0 for r in got.values() if r.n_confirmed)


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = Counter(r.text for r in quality.keep_quality(docs, labels).collect())
    assert 0 < sum(kept.values()) < docs.count()
    none = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 1, F.col("doc_id")))
    got = quality.keep_quality(none, labels)
    assert got.schema == none.schema and got.where("doc_id is null").count() == quality.quality_scores(none, labels).where("doc_id is null and predicted = 1").count() > 0
    # texts a and b are near copies, c is not
    a = " ".join(f"w{i}" for i in range(60))
    b, c = a + " more", " ".join(f"x{i}" for i in range(60))
    rows = [(None, a, "s"), (None, b, "s"), (None, c, "s"), (7, c, "s"), (5, "q r s t u v", "s"), (5, "q r s t u v", "s"), (5, "a b c d e f g", "s"), (6, None, "s"), (6, None, "s"), (6, "", "s"), (None, None, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one = jaccard.one_of_each(table)
    assert one.columns == table.columns
    left = Counter((r.doc_id, r.text) for r in one.collect())
    assert left[None, a] + left[None, b] == 1 and set(left.values()) == {1}
    assert set(left) - {(None, a), (None, b)} == {(None, c), (5, "q r s t u v"), (5, "a b c d e f g"), (6, None), (6, ""), (None, None)}
    plan = Counter()
    for r in mixing.mix_plan(table).collect():
        plan[r.doc_id, r.size] += r.copies
    mixed = Counter((r.doc_id, len((r.text or "").split())) for r in mixing.mix(table).collect())
    assert mixed == +plan and sum(mixed.values()) > 0


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from helixframe.llm.queries import secret

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL).collect()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    good = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id]]
    first = {root for _, root in classes(good).values()}
    kept = docs.where(F.col("doc_id").isin(list(first)))
    hidden = {r.doc_id: r.text for r in pii.pseudonymize(kept, secret(spark)).collect()}
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(pii.pseudonymize(kept, secret(spark))).collect() if r.copies}
    assert Counter(r.doc_id for r in out) == Counter(plan)
    assert all(r.ids == library.encode(hidden[r.doc_id] or "", add_special_tokens=False).ids for r in out)
    assert defaultdict(int, Counter(scores.values()))[1] > 0


def test_hinge_and_ratios():
    """Ratios by counting, and dual coordinate descent against the duality gap."""
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, 8)) for _ in range(80)]
    labels = np.array([int((s < 12).sum() > 2 or rng.random() < 0.2) for s in sets])
    counts, total = np.zeros((2, 40)), np.bincount(labels, minlength=2).astype(float)
    for s, y in zip(sets, labels):
        counts[y, s] += 1
    ratios = quality.ratios_of(counts, total)
    share = lambda y, f: (counts[y, f] + 2 * total[y] / 80) / (total[y] + 2 * total[y] / 80)
    assert all(abs(ratios[f] - np.log(share(1, f) / share(0, f))) < 1e-12 for f in range(40)) and abs(ratios[35]) < 1e-12
    weights, bias = quality.fit_hinge(sets, labels, ratios, cost=0.5, rounds=4000)
    x = np.zeros((80, 41))
    for i, s in enumerate(sets):
        x[i, s], x[i, 40] = ratios[s], 1.0
    used = ratios != 0
    w = np.append(np.where(used, weights / np.where(used, ratios, 1), 0), bias)
    y, one = np.where(labels == 1, 1.0, -1.0), labels.mean()
    cost = 0.5 * np.where(y > 0, 0.5 / one, 0.5 / (1 - one))
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    # projected gradient ascent on the dual by other means: its value bounds every primal value from below
    alpha, q = np.zeros(80), (x * y[:, None]) @ (x * y[:, None]).T
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(100_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    assert dual - 1e-6 <= primal(w) <= dual + 1e-3 * abs(dual)
