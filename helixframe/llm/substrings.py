"""Operator 5: passages that stood before are removed, each word of them.

A window is ``length`` consecutive words of one document. A window is repeated if its
word sequence also starts earlier, in a document with a smaller id or earlier in its
own. Passages are compared in suffix automata of reference shards: a shard is named by
the least hash of short word sequences in a window, so equal windows always share one,
and each passage streams through its shard's automaton for matching statistics, in the
order of documents, before it is added itself. The shards are shuffled and never
broadcast, since every document is a reference for later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.blocks import FLAG_SCHEMA, KEY_SCHEMA, Block, bucket_bits, flag_table, id_array, key_rows, pack, read_flags, repeated, runs, with_flags
from helixframe.llm.common import mapped, mix64, ship, written

LENGTH = 20
ANCHOR = 5  # words of the sequences whose least hash names a window's shard
OUT_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:bigint,end:bigint>>"


class SuffixAutomaton:
    """Of the word sequences fed to it so far; each state is a class of their substrings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, p: int, word: int, q: int) -> int:
        """A state for the shorter substrings of q, those that end as p and the word do."""
        new = len(self.size)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, word: int) -> int:
        """Add one more word to the sequence that ends in state ``last``."""
        follow, link, size = self.next, self.link, self.size
        q = follow[last].get(word)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._clone(last, word, q)
        new, p = len(size), last
        follow.append({}), link.append(0), size.append(size[last] + 1)
        while p >= 0 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, word, q)
        return new

    def feed(self, words: list[int]) -> list[int]:
        """Add a sequence; for each word the length of the longest match, ending there, with what came before."""
        follow, link, size = self.next, self.link, self.size
        last = state = matched = 0
        lengths = []
        for word in words:
            to = follow[state].get(word)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = follow[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            lengths.append(matched)
            last = self._extend(last, word)
            if state and size[link[state]] >= matched:  # the state was split
                state = link[state]
        return lengths


class _Windows:
    """All windows of a block: hashes, document and start, and the distinct first hashes."""

    def __init__(self, block: Block, length: int, hashes: int):
        a, b, doc, start, counts, words_of, word, least, before = [], [], [], [], [], [], [], [], 0
        for first, _, words in block.words(hashes=hashes):
            at, h = words.grams(length)
            a.append(h), doc.append((words.doc[at] + first).astype(np.int32)), start.append((at - words.first[words.doc[at]]).astype(np.int32)), counts.append(words.counts)
            if hashes > 1:
                b.append(words.grams(length, 1)[1])
                words_of.append(words.hashes[0]), word.append((at + before).astype(np.int32)), least.append(_least(words, at, length))
                before += len(words.starts)
        self.a, self.doc, self.start = np.concatenate(a), np.concatenate(doc), np.concatenate(start)
        if hashes > 1:
            self.b, self.words, self.word, self.least = np.concatenate(b), np.concatenate(words_of), np.concatenate(word), np.concatenate(least)
        self.counts = np.concatenate(counts)
        self.keys, self.at, times = np.unique(self.a, return_inverse=True, return_counts=True)
        self.twice = times > 1


def _least(words, at: np.ndarray, length: int) -> np.ndarray:
    """For the windows at these words the least hash of the ``ANCHOR``-word sequences in them."""
    size = min(ANCHOR, length)
    low = np.full(len(words.starts), np.iinfo(np.uint64).max, dtype=np.uint64)
    places, h = words.grams(size)
    low[places] = h
    span, want = 1, length - size + 1
    while span < want:  # low[i] covers the sequences from i to i + span
        step = min(span, want - span)
        low[:-step] = np.minimum(low[:-step], low[step:])
        span += step
    return low[at]


class _Candidates:
    """Windows that may stand elsewhere too, and passages of those that are the earliest in the block."""

    def __init__(self, block: Block, windows: _Windows, rows: list[dict], bits: int):
        flagged = read_flags(rows, 1, windows.keys, bits)[0] | windows.twice
        self.places = np.flatnonzero(flagged[windows.at])
        a, b = windows.a[self.places], windows.b[self.places]
        order = np.lexsort((windows.start[self.places], block.ids[windows.doc[self.places]], b, a))
        is_first = np.ones(len(order), dtype=bool)
        is_first[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        self.again = self.places[order[~is_first]]
        # a passage: windows one after another that belong to one shard
        p = np.sort(self.places[order[is_first]])
        least = windows.least[p]
        begins = np.ones(len(p), dtype=bool)
        begins[1:] = (np.diff(p) != 1) | (np.diff(windows.doc[p]) != 0) | (np.diff(least) != 0)
        at = np.flatnonzero(begins)
        bucket = (mix64(least[at]) >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        self.first, self.sizes = p[at[order]], np.diff(np.append(at, len(p)))[order]  # first windows, numbers of windows
        self.buckets, self.bounds = runs(bucket[order])

    def windows(self, bucket: int) -> np.ndarray:
        """Places of the windows sent to a bucket, in the order sent."""
        i = int(np.searchsorted(self.buckets, bucket))
        some = slice(self.bounds[i], self.bounds[i + 1])
        return _ranges(self.first[some], self.sizes[some])


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... sizes[0] numbers, then those from first[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def _passage_rows(block: Block, windows: _Windows, found: _Candidates, length: int) -> pa.Table:
    """Rows (bucket, part, payload): number of passages, their shards, ids, starts and numbers of words, the words."""
    full, payload = found.buckets, []
    for i in range(len(full)):
        some = slice(found.bounds[i], found.bounds[i + 1])
        first, n_words = found.first[some], found.sizes[some] + length - 1
        heads = [windows.least[first], block.ids[windows.doc[first]].view(np.uint64), windows.start[first].astype(np.uint64), n_words.astype(np.uint64)]
        words = windows.words[_ranges(windows.word[first].astype(np.int64), n_words)]
        payload.append(np.concatenate([np.array([len(first)], dtype=np.uint64), *heads, words]).tobytes())
    return pa.table({"bucket": pa.array(full), "part": pa.array([block.part] * len(full), pa.int64()), "payload": pa.array(payload, pa.binary())})


def _matched(table: pa.Table, length: int) -> pa.Table:
    """For each block a bit per window sent: does it start earlier in another block?

    The passages of a shard stream through its automaton by document and start. A block
    sends a window once, so a passage alone in its shard has no earlier one.
    """
    shard, doc, start, n_words, words, cuts = [], [], [], [], [], [0]
    for raw in table.column("payload").to_pylist():
        values = np.frombuffer(raw, dtype=np.uint64)
        n = int(values[0])
        for to, part in zip((shard, doc, start, n_words), values[1 : 1 + 4 * n].reshape(4, n), strict=True):
            to.append(part)
        words.append(values[1 + 4 * n :])
        cuts.append(cuts[-1] + len(words[-1]) - n * (length - 1))
    shard, doc, start, n_words = np.concatenate(shard), np.concatenate(doc).view(np.int64), np.concatenate(start), np.concatenate(n_words).astype(np.int64)
    words = np.concatenate(words)
    word_at, window_at = np.cumsum(n_words) - n_words, np.cumsum(n_words - length + 1) - (n_words - length + 1)
    later = np.zeros(cuts[-1], dtype=bool)
    order = np.lexsort((start, doc, shard))
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)), len(order))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a == 1:
            continue
        automaton = SuffixAutomaton()
        for i in order[a:b]:
            lengths = automaton.feed(words[word_at[i] : word_at[i] + n_words[i]].tolist())
            later[window_at[i] : window_at[i] + n_words[i] - length + 1] = np.array(lengths[length - 1 :]) >= length
    return flag_table(table.column("bucket")[0].as_py(), 2, table.column("part").to_pylist(), np.split(later, cuts[1:-1]))


def _spans(starts: np.ndarray, length: int) -> list[dict]:
    """Union of windows at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    begin, last = np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1])
    return [{"start": int(s), "end": int(e) + length} for s, e in zip(begin, last, strict=True)]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_text, spans (word places removed).

    ``kept_text`` joins the kept words by one space. Windows are judged on the input, so
    what is removed elsewhere makes no difference. Null texts have no words. Ids should be
    unique; of rows with one id and equal windows one counts as the earlier.

    Three passes over packed texts: distinct window hashes meet by their leading bits, a
    bit tells which occur in two blocks; the passages of those alone, as word hashes, go to
    the automata of their shards; the last pass cuts. Only such hashes, passages and bits
    are shuffled, besides the packed texts.
    """
    blocks = pack(docs, key=key, text=text)
    bits = bucket_bits(blocks)
    ship(docs.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield key_rows(row["part"], _Windows(Block(row), length, 1).keys, bits)

    def passages(block: Block, rows: list[dict]) -> pa.Table:
        windows = _Windows(block, length, 2)
        return _passage_rows(block, windows, _Candidates(block, windows, rows, bits), length)

    def matched(table: pa.Table) -> pa.Table:
        return _matched(table, length)

    def cut(block: Block, rows: list[dict]) -> pa.Table:
        windows = _Windows(block, length, 2)
        found = _Candidates(block, windows, rows, bits)
        gone = [found.again]
        for row in rows:
            if row["kind"] == 2:
                sent = found.windows(row["bucket"])
                gone.append(sent[np.unpackbits(np.frombuffer(row["flags"], dtype=np.uint8), count=len(sent), bitorder="little").astype(bool)])
        places = np.sort(np.concatenate(gone))  # by document and start, as windows stand
        doc, start = windows.doc[places], windows.start[places]
        ends = np.searchsorted(doc, np.arange(len(block.ids) + 1))
        spans, kept, removed = [], [], np.zeros(len(block.ids), dtype=np.int64)
        for i in range(len(block.ids)):
            own = _spans(start[ends[i] : ends[i + 1]], length)
            words = block.text(i).split()
            for s in reversed(own):
                del words[s["start"] : s["end"]]
            spans.append(own), kept.append(b" ".join(words).decode())
            removed[i] = windows.counts[i] - len(words)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": id_array(block.ids), "n_words": pa.array(windows.counts), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, kind)})

    twice = written(repeated(mapped(blocks, hashes, KEY_SCHEMA)), "repeated")
    first = with_flags(blocks, twice, passages, KEY_SCHEMA).groupBy("bucket").applyInArrow(matched, FLAG_SCHEMA)
    return with_flags(blocks, twice.unionByName(first), cut, OUT_SCHEMA)
