"""Operator 4: Jaccard join of shingle sets by PartEnum signatures, and its classes.

Two sets of hashes with Jaccard similarity 0.8 or more differ in at most (a + b) / 9
elements. Sizes are cut into bands so that such sets stand in one band or in two
neighbouring ones; an instance of the scheme serves two neighbouring bands, with k the
most elements in which its similar sets differ. Its feature domain is dealt by hash to
partitions, each to CELLS second-level ones; of these every subset without one cell is
enumerated, and what a set has in the subset is a signature. Similar sets have fewer than
two differences in all partitions but k / 2, so they agree on a subset in each of the
others. (Where k is small a partition is not cut, and agrees where nothing differs.)

Empty subsets are no signatures, since many sets would share them. With m spare
partitions, and e of a set's partitions with an empty subset, it shares m + 1 - e
signatures with each partner if e is at most m; so it needs as many that occur elsewhere,
and only the rarest, all but that number less one, need be joined. A set with more such
partitions deals its elements anew by another hash, and so on; at the last level emptiness
itself is a signature, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.blocks import KEY_SCHEMA, NULL_ID, Block, bucket_bits, key_rows, pack, read_flags, repeated, with_flags
from helixframe.llm.common import WORD_CLASS, distinct, mapped, mix64, numbered, scratch, written
from helixframe.llm.components import components
from helixframe.llm.fingerprint import shingle_sets

PERCENT = 80
LEVELS = 6
CELLS = 3  # second-level partitions; subsets of all but one are enumerated
CUT_FROM = 16  # differences from which partitions are cut
FIRST = 32  # signatures of a set by which a pair that comes up again is known
PAIRS = 4  # for each row; with more pairs to come, sets without enough shared elements are left out first
_SEEDS = mix64(np.arange(1, LEVELS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Scheme:
    """Bands of sizes, and for each instance its k, cells and subsets of a partition, spare partitions m and partitions n."""

    def __init__(self, largest: int, percent: int = PERCENT):
        self.low = [1]
        high = []
        while True:
            high.append(self.low[-1] * 100 // percent)
            if high[-1] >= largest:
                break
            self.low.append(high[-1] + 1)
        # one more instance for the band above the last
        high.append((high[-1] + 1) * 100 // percent)
        top = np.array(high, dtype=np.int64)
        # 100 (a + b - d) >= percent (a + b + d) with a, b <= top
        self.k = 2 * top * (100 - percent) // (100 + percent)
        cut = self.k >= CUT_FROM
        self.cells = np.where(cut, CELLS, 1)
        bad = np.where(cut, self.k // 2, self.k)  # partitions that needn't agree on a subset
        self.m = np.where(cut, -(-bad // 8), -(-(self.k + 1) // 5)) + 1
        self.n = bad + 1 + self.m

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1


class Signatures:
    """Signatures of a run of sets: for each, its set, instance (0 own band, 1 next) and value."""

    def __init__(self, sets: list[np.ndarray], scheme: Scheme):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.need = np.ones((len(sets), 2), dtype=np.int64)
        self._sets, self._scheme, self._out = sets, scheme, []
        band = scheme.band(self.sizes)
        for side in (0, 1):
            cells = scheme.cells[np.minimum(band + side, len(scheme.cells) - 1)]
            for c in (1, CELLS):
                self._deal(np.flatnonzero((self.sizes > 0) & (cells == c)), side, c)
        parts = list(zip(*self._out, strict=True)) or [(), (), ()]
        self.of, self.which, self.value = (np.concatenate([*x, np.zeros(0, dtype=k)]) for x, k in zip(parts, (np.int64, np.int64, np.uint64), strict=True))

    def _add(self, rows: np.ndarray, side: int, values: np.ndarray) -> None:
        self._out.append((rows, np.full(len(rows), side, dtype=np.int64), values))

    def _deal(self, rows: np.ndarray, side: int, cells: int) -> None:
        """Signatures of sets whose instance has so many cells in a partition."""
        for level in range(LEVELS):
            if not len(rows):
                return
            instance = self._scheme.band(self.sizes[rows]) + side
            n, m = self._scheme.n[instance], self._scheme.m[instance]
            base = np.concatenate([[0], np.cumsum(n)])  # of each set's partitions
            elements = mix64(np.concatenate([self._sets[i] for i in rows]) ^ _SEEDS[level])
            owner = np.repeat(np.arange(len(rows)), self.sizes[rows])
            cell = ((elements >> np.uint64(32)) % (n[owner] * cells).astype(np.uint64)).astype(np.int64) + base[owner] * cells
            sums, full = np.zeros(base[-1] * cells, dtype=np.uint64), np.zeros(base[-1] * cells, dtype=bool)
            np.add.at(sums, cell, mix64(elements))
            full[cell] = True
            sums, full = sums.reshape(-1, cells), full.reshape(-1, cells)
            row = np.repeat(np.arange(len(rows)), n)
            tag = mix64((instance[row] * LEVELS + level).astype(np.uint64) << np.uint64(40) | (np.arange(base[-1]) - base[row]).astype(np.uint64))
            short = np.zeros(base[-1], dtype=bool)
            for left in range(cells):  # the subset without this cell, or the whole partition
                kept = [c for c in range(cells) if c != left or cells == 1]
                some = full[:, kept].any(axis=1)
                short |= ~some
                value = tag + np.uint64(left)
                for c in kept:
                    value = mix64(value ^ sums[:, c])
                self._add(rows[row[some]], side, value[some])
            missing = np.bincount(row[short], minlength=len(rows))
            more = missing > m
            if level == 0:
                self.need[rows, side] = np.where(more, 1, m + 1 - missing)
            elif level == LEVELS - 1:
                self._add(rows[more], side, mix64(mix64(instance[more].astype(np.uint64)) ^ np.uint64(0xE)))
            rows = rows[more]


def _sets(block: Block, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, _, words in block.words(lower=True):
        yield a, list(shingle_sets(words, size))


def _shared_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: the exact check on whole sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def _fitting(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity, smaller id first, each once."""
    ok = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return rows.where((F.col("a") != F.col("b")) & ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similarity_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Texts are lower-cased (A-Z). A text with fewer words than a shingle is one shingle; a
    text without words, or null, has none and links with nothing. Equal sets are joined
    first and one of each goes on. A null id ranks first and, alone
    in its class, stays null. Rows with one id, null too, are one document with several
    texts, each of which links it; repeated rows stay.

    Sets that share a rare signature are first compared with one of their number, so a group
    of n near copies costs n comparisons, then with others by chance; what still stands in
    several classes but shares a rare signature is compared pair by pair. No pair of equal sets or of one class is made.
    """
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            sized, firsts, kept = _candidates(docs, key, text, shingle, percent)
        roots = written(_classes(kept, percent), "roots", keep=1)
    equal = ["n_shingles", "h1", "h2"]
    named = firsts.join(roots, firsts["rep"] == roots["node"], "left").select(*equal, F.coalesce("root", "rep").alias("component_id"))
    out = sized.join(named, equal, "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    blank = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(blank("id").alias("doc_id"), "n_shingles", blank("component_id").alias("component_id"))


def _candidates(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the size and two hashes of their sets, the first row of each set, and the sets with signatures that occur elsewhere."""
    blocks = pack(docs, key=key, text=text)
    bits = bucket_bits(blocks)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                found = [s for _, sets in _sets(block, shingle) for s in sets]
                n = len(found)
                one = np.array([s.sum(dtype=np.uint64) for s in found], dtype=np.uint64).astype(np.int64)
                two = np.array([mix64(s ^ _SEEDS[1]).sum(dtype=np.uint64) for s in found], dtype=np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array([block.part] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int64)), pa.array([len(s) for s in found], pa.int64()), pa.array(one), pa.array(two)], ["id", "part", "at", "n_shingles", "h1", "h2"])

    sized = written(mapped(blocks, facts, "id bigint, part bigint, at bigint, n_shingles bigint, h1 bigint, h2 bigint"), "sets", keep=2)
    equal = ["n_shingles", "h1", "h2"]
    firsts = sized.where("n_shingles > 0").groupBy(*equal).agg(F.min(F.struct("id", "part", "at")).alias("f"))
    firsts = written(firsts.select(*equal, F.col("f.id").alias("rep"), F.col("f.part").alias("part"), F.col("f.at").alias("at")), "firsts", keep=2)
    largest = firsts.agg(F.max("n_shingles")).first()[0] or 1
    scheme = Scheme(int(largest), percent)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                yield key_rows(block.part, distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *(Signatures(s, scheme).value for _, s in _sets(block, shingle))])), bits)

    def candidates(block: Block, rows: list[dict]) -> pa.Table:
        wanted = {row["bucket"] for row in rows if row["kind"] == 0}
        sets, of, which, value, need = [], [], [], [], []
        for first, found in _sets(block, shingle):
            s = Signatures(found, scheme)
            sets += found
            of.append(s.of + first), which.append(s.which), value.append(s.value), need.append(s.need)
        of, which, value, need = np.concatenate(of), np.concatenate(which), np.concatenate(value), np.concatenate(need)
        every, at, times = np.unique(value, return_inverse=True, return_counts=True)
        flagged, often = read_flags(rows, 1, every, bits)
        hit = (flagged | (times > 1))[at] & np.isin(of, np.fromiter(wanted, dtype=np.int64, count=len(wanted)))
        of, which, value, often = of[hit], which[hit], value[hit], often[at[hit]]
        order = np.lexsort((value, often, which, of))
        of, which, value = of[order], which[order], value[order]
        # of a set's f signatures that occur elsewhere the f - need + 1 rarest, by an order that all blocks share
        group = of * 2 + which
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
        f = np.diff(np.append(begin, len(group)))
        place = np.arange(len(group)) - np.repeat(begin, f)
        kept = place <= np.repeat(f, f) - need[of, which]
        of, value = of[kept], value[kept].astype(np.int64)
        picked, begin = np.unique(of, return_index=True)
        ends = np.append(begin[1:], len(of))[: len(begin)]
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.table({"rep": pa.array(block.ids[picked], pa.int64()), "n": pa.array([len(sets[i]) for i in picked], pa.int64()), "signatures": lists([value[a:b] for a, b in zip(begin, ends, strict=True)]), "shingles": lists([sets[i].astype(np.int64) for i in picked])})

    flags = repeated(mapped(blocks, keys, KEY_SCHEMA))
    wanted = firsts.select("part", F.lit(0).alias("kind"), F.col("at").cast("int").alias("bucket"), F.lit(None).cast("binary").alias("flags"))
    kept = written(with_flags(blocks, flags.unionByName(wanted), candidates, "rep bigint, n bigint, signatures array<bigint>, shingles array<bigint>"), "candidates", keep=1)
    return sized, firsts, kept


def _with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with an aggregate of theirs by ``key``, which may be hot.

    The aggregate is written first: then both sides of the join are plain exchanges, of
    which the adaptive planner may split a hot key's rows, or the aggregate is small
    enough to be broadcast by its measured size.
    """
    return rows.join(written(groups, "groups"), key)


def _leading_signatures(kept: DataFrame) -> DataFrame:
    """(signature, rep, n, free): one of the signatures that the same sets have, if it is more than one set.

    Near copies share many signatures; those that bring the same pairs are told by two
    hashes over their sets. ``free`` is the most elements that a partner may have too.
    """
    rows = kept.select("rep", "n", F.explode("signatures").alias("signature"))
    sets = [F.count("*").alias("sets"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("rep").alias("low"), F.max("rep").alias("high")]
    groups = rows.groupBy("signature").agg(*sets).where("sets > 1")
    leading = groups.groupBy("sets", "x", "y", "low", "high").agg(F.min("signature").alias("signature")).select("signature")
    return _with_groups(rows, leading, "signature").select("signature", "rep", "n", F.col("n").alias("free"))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the signatures whose sets stand in several classes, with each set's class."""
    rows = rows.drop("root")
    placed = rows.join(roots, rows["rep"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("signature").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("signature")
    return _with_groups(placed, mixed, "signature")


def _linkable(rows: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """``rows`` without the sets that have too many elements which no other class has.

    Of a set's n elements ``free`` occur in another class of ``rows`` too. With a partner of
    m elements there it must share percent / (100 + percent) of n + m, so it can do without
    all partners if that is more than ``free`` for the smallest m that shares a signature.
    """
    docs = written(rows.select("rep", "root").distinct(), "docs")
    elements = written(kept.select("rep", "shingles").join(docs, "rep").select("rep", "root", F.explode("shingles").alias("e")), "elements")
    shared = elements.groupBy("e").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("e")
    free = _with_groups(elements, shared, "e").groupBy("rep").agg(F.count("*").alias("free"))
    low = rows.groupBy("signature").agg(F.min("n").alias("low"))
    counted = _with_groups(rows.drop("free").join(free, "rep"), low, "signature")
    return written(counted.where(F.col("free") * (100 + percent) >= (F.col("n") + F.col("low")) * percent).select("signature", "rep", "n", "free"), "linkable")


def _within(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets that stand in ``rows``, written: most don't, and whoever reads sets moves whole arrays."""
    return written(kept.join(written(rows.select("rep").distinct(), "docs"), "rep", "left_semi").select("rep", "shingles"), "kept")


def _heads(members: DataFrame, rank) -> DataFrame:
    """Of each signature the set that ranks first, with those of other classes: a, na, b, nb."""
    first = F.min(F.struct(rank.alias("r"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra")))
    heads = members.groupBy("signature").agg(first.alias("h")).select("signature", "h.a", "h.na", "h.ra")
    return _with_groups(members.withColumnsRenamed({"rep": "b", "n": "nb"}), heads, "signature").where("root <> ra")


def _many_pairs(rows: DataFrame) -> bool:
    n = F.col("n").cast("double")
    found = rows.groupBy("signature").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2), F.sum(n)).first()
    return (found[0] or 0) > PAIRS * (found[1] or 0)


def _classes(kept: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the linked sets, from rows (rep, n, signatures, shingles)."""
    rows = written(_leading_signatures(kept), "leading")
    links = written(_shared_links(_fitting(_heads(rows.withColumn("root", F.col("rep")), F.col("rep")), percent), kept, percent), "links")
    roots = components(links)
    rest = written(_open(rows, roots), "open")
    for _ in range(2):  # fewer sets share fewer elements
        if _many_pairs(rest):
            rest = written(_open(_linkable(rest, kept, percent), roots), "open")
            kept = _within(kept, rest)
    if _many_pairs(rest):  # another of each signature by chance: a set meets as many as it has signatures
        found = written(_shared_links(_fitting(_heads(rest, F.xxhash64("rep", "signature")), percent), kept, percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
            rest = written(_open(_linkable(written(_open(rest, roots), "open"), kept, percent), roots), "open")
    if rest.isEmpty():
        return roots
    # a pair comes up at the first signature it shares, and seldom again: at others than the first 32 of either set
    first = rest.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("signature")), 1, FIRST).alias("first"))
    rest = _with_groups(rest, first, "rep")
    left = rest.select("signature", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("free").alias("fa"), F.col("first").alias("la"))
    right = rest.select("signature", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("free").alias("fb"), F.col("first").alias("lb"))
    can = (F.col("ra") < F.col("rb")) & (F.least("fa", "fb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    new = F.coalesce(F.array_min(F.array_intersect("la", "lb")) >= left["signature"], F.lit(True))
    pairs = left.join(right, (left["signature"] == right["signature"]) & can & new).select("a", "na", "b", "nb")
    found = written(_shared_links(_fitting(pairs, percent), kept, percent), "links")
    return roots if found.isEmpty() else components(links.unionByName(found))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each group of near copies the row with the smallest id (null before others).

    Where ids repeat, rows are told apart by a number: different texts under one id are
    documents of their own, and repeated rows, without words too, come down to one.
    """
    found = numbered(docs, key)
    if found is None:
        classes = similarity_classes(docs, key=key, text=text, **options).where("doc_id <=> component_id")
        kept = classes.select(F.col("doc_id").alias("kept"))
        return docs.join(kept, docs[key].eqNullSafe(kept["kept"]), "left_semi").select(docs.columns)
    rows, row = found
    classes = similarity_classes(rows, key=row, text=text, **options).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(WORD_CLASS)
    same = F.when(wordless, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256))
    ids = rows.select(F.col(row).alias("row"), F.col(key).alias("id"), same.alias("same"))
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    kept = classes.join(ids, "row").groupBy(group, "same").agg(F.min(F.struct("id", "row"))["row"].alias("kept"))
    return rows.join(kept, rows[row] == kept["kept"], "left_semi").select(docs.columns)
