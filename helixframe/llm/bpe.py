"""BPE as a finite automaton over tokens.

The automaton starts with one state and a loop for each byte. Each merge
``u v -> w`` adds one gadget: wherever an arc ``u`` leads to a state with an arc
``v``, an arc ``w`` is laid over the two, and the state behind ``u`` loses its
arc ``v``. All arcs with one label lead to one state, so a state is named by the
token last read. Written out, 50,000 merges give billions of arcs; this class
keeps what each gadget changed (the pair that was cut, and the two parts of the
new label) and works out an arc of the determinised automaton when it is first
asked for, then keeps it in a transition table.

A string of tokens is accepted just if it is what BPE makes of its bytes, so
every prefix of a word has one accepted path, and reading left to right with the
last token of each prefix as state finds it without search.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from helixframe.llm.common import SLICE_BYTES, buffers, slices, tiled_hash

#: Fixed value: the published pre-tokenization pattern of byte-level BPE, which split_places follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 64  # bytes; longer words are read one by one
CACHE_WORDS = 1_200_000
TABLE_BITS = 21
MEMO_ARCS = 1 << 20  # arcs known by heart while long words are read
PORTION = 1 << 19  # characters split into words at once
PORTION_WORDS = 1 << 18  # words looked up at once


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_supported(spec: dict) -> None:
    """Raise for a tokenizer file whose words or ids other rules than those of this module decide."""
    split = spec.get("pre_tokenizer") or {"type": "ByteLevel"}
    model = spec["model"]
    wrong = [
        name
        for name, bad in (
            ("normalizer", spec.get("normalizer") is not None),
            ("pre_tokenizer", split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)),
            ("model", model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))),
            ("added_tokens", any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"byte-level BPE alone is supported, not this {', '.join(wrong)}")


class Automaton:
    """Token automaton of a tokenizer file in the JSON form of byte-level BPE."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        check_supported(spec)
        model, byte = spec["model"], byte_characters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.labels: list[bytes] = [b""] * n
        for text, i in vocab.items():
            if text not in self.special:
                self.labels[i] = bytes(byte[c] for c in text)
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.n = n
        self._compile([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], vocab)
        self._arcs(sorted(i for t, i in vocab.items() if t not in self.special))
        self._table_key = np.full(1 << 20, -1, dtype=np.int64)
        self._table = np.zeros(1 << 20, dtype=bool)
        self._long_tables: list = []  # as Python lists, made for the first long word

    def _compile(self, merges: list[tuple[str, str]], vocab: dict[str, int]) -> None:
        """Apply the gadgets in order: what each cut, and what its new label consists of."""
        self.rank = np.full(self.n, -1, dtype=np.int64)
        self.left, self.right = np.arange(self.n), np.arange(self.n)
        cut = {}
        for k, (u, v) in enumerate(merges):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if self.rank[w] >= 0:
                raise ValueError(f"two merges make {u + v!r}")
            self.rank[w], self.left[w], self.right[w] = k, a, b
            cut[a * self.n + b] = k
        keys = np.array(sorted(cut), dtype=np.int64)
        self._cut_keys, self._cut_ranks = keys, np.array([cut[int(k)] for k in keys], dtype=np.int64)

    def _arcs(self, tokens: list[int]) -> None:
        """A trie of the labels; nodes that have children come first."""
        node_of = {b"": 0}
        children: dict[int, list[tuple[int, int]]] = {}
        token_at = {}
        for i in tokens:
            label = self.labels[i]
            for k in range(1, len(label) + 1):
                if label[:k] not in node_of:
                    node_of[label[:k]] = len(node_of)
                    children.setdefault(node_of[label[: k - 1]], []).append((label[k - 1], node_of[label[:k]]))
            token_at[node_of[label]] = i
        inner = {old: new for new, old in enumerate(sorted(children))}
        number = inner | {old: len(inner) + i for i, old in enumerate(x for x in range(len(node_of)) if x not in inner)}
        self._child = np.zeros((len(inner), 256), dtype=np.int32)  # 0, the root, is nobody's child
        for old, row in children.items():
            for byte, to in row:
                self._child[inner[old], byte] = number[to]
        self._inner = len(inner)
        self._token = np.full(len(node_of), -1, dtype=np.int64)
        for old, i in token_at.items():
            self._token[number[old]] = i
        self._length = np.array([len(x) for x in self.labels], dtype=np.int64)
        self._label_start = np.concatenate([[0], np.cumsum(self._length)])
        self._label_bytes = np.frombuffer(b"".join(self.labels), dtype=np.uint8)

    def _work_out(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of that label once all gadgets are applied.

        The two tokens are taken apart, the later made first; the arc is gone if
        a merge across their border came before the parts were joined otherwise.
        """
        has = np.ones(len(state), dtype=bool)
        l, r, live = state.copy(), label.copy(), np.arange(len(state))
        limit = np.full(len(state), np.iinfo(np.int64).max)
        while len(live):
            key = l * self.n + r
            at = np.minimum(np.searchsorted(self._cut_keys, key), len(self._cut_keys) - 1) if len(self._cut_keys) else np.zeros(len(key), dtype=np.int64)
            met = (self._cut_keys[at] == key) & (self._cut_ranks[at] < limit) if len(self._cut_keys) else np.zeros(len(key), dtype=bool)
            has[live[met]] = False
            rl, rr = self.rank[l], self.rank[r]
            go = ~met & ((rl >= 0) | (rr >= 0))
            live, l, r, rl, rr = live[go], l[go], r[go], rl[go], rr[go]
            by_left = rl > rr
            limit = np.where(by_left, rl, rr + 1)
            l, r = np.where(by_left, self.right[l], l), np.where(by_left, r, self.left[r])
        return has

    def has_arc(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The transition table; arcs not yet in it are worked out and stored."""
        key = state * self.n + label
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out = self._table[slot]
        new = np.flatnonzero(self._table_key[slot] != key)
        if len(new):
            out[new] = found = self._work_out(state[new], label[new])
            self._table_key[slot[new]], self._table[slot[new]] = key[new], found
            # two new arcs can share a slot: keep what belongs together
            lost = new[self._table_key[slot[new]] != key[new]]
            kept = new[self._table_key[slot[new]] == key[new]]
            self._table[slot[kept]] = out[kept]
            del lost
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words one after another, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], dtype=np.int64)
        out: list = [None] * len(raw)
        short = np.flatnonzero(sizes <= LONG_WORD)
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = self._encode_long(raw[i])
        counts = np.zeros(len(raw), dtype=np.int64)
        for i in np.flatnonzero(sizes > LONG_WORD):
            counts[i] = len(out[i])
        short = short[np.argsort(-sizes[short], kind="stable")]  # the longest first: the live ones are a prefix
        last, first, size = self._read(b"".join(raw[i] for i in short), sizes[short])
        steps, at, live = [], first + size, np.arange(len(short))
        live = live[size > 0]
        while len(live):  # back along the path
            token = last[at[live]]
            steps.append((live, token))
            at[live] -= self._length[token]
            counts[short[live]] += 1
            live = live[at[live] > first[live]]
        begin = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(begin[-1], dtype=np.uint32)
        put = begin[1:].copy()
        for live, token in steps:
            put[short[live]] -= 1
            flat[put[short[live]]] = token
        for i in np.flatnonzero(sizes > LONG_WORD):
            flat[begin[i] : begin[i + 1]] = out[i]
        return flat, counts

    def _read(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last token of every prefix of every word, by table-driven transitions."""
        text = np.frombuffer(data, dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        first = start + np.arange(len(size))  # one more place than bytes for each word
        last = np.full(len(text) + len(size), -1, dtype=np.int64)
        longest = int(size.max()) if len(size) else 0
        for i in range(longest):
            word = np.arange(int(np.searchsorted(-size, -i, side="left")))  # those longer than i
            state, node, j = last[first[word] + i], np.zeros(len(word), dtype=np.int64), i
            while len(word):
                node = self._child[node, text[start[word] + j]].astype(np.int64)
                j += 1
                token = self._token[node]
                ends = np.flatnonzero((node > 0) & (token >= 0))
                if len(ends):
                    s, t = state[ends], token[ends]
                    ok = np.ones(len(ends), dtype=bool) if i == 0 else self.has_arc(s, t)
                    last[first[word[ends[ok]]] + j] = t[ok]
                go = np.flatnonzero((node > 0) & (node < self._inner) & (size[word] > j))
                word, state, node = word[go], state[go], node[go]
        return last, first, size

    def _one_arc(self, l: int, r: int) -> bool:
        """``_work_out`` for one state and label."""
        rank, left, right, cut = self._plain_tables
        limit = 1 << 62
        while True:
            if cut.get(l * self.n + r, limit) < limit:
                return False
            rl, rr = rank[l], rank[r]
            if rl < 0 and rr < 0:
                return True
            if rl > rr:
                limit, l = rl, right[l]
            else:
                limit, r = rr + 1, left[r]

    def _encode_long(self, word: bytes) -> list[int]:
        """The same reading of one word, without its lengths squared in memory."""
        if not self._long_tables:
            cut = dict(zip(self._cut_keys.tolist(), self._cut_ranks.tolist(), strict=True))
            self._plain_tables = self.rank.tolist(), self.left.tolist(), self.right.tolist(), cut
            self._long_tables = [self._child.tolist(), self._token.tolist(), {}]
        children, token_at, memo = self._long_tables
        if len(memo) > MEMO_ARCS:
            memo.clear()
        last = [-1] * (len(word) + 1)
        for i in range(len(word)):
            node, j, base = 0, i, last[i] * self.n
            while j < len(word):
                node = children[node][word[j]]
                if not node:
                    break
                j += 1
                token = token_at[node]
                if token >= 0:
                    if not i:
                        last[j] = token
                    else:
                        arc = memo.get(base + token)
                        if arc is None:
                            arc = memo[base + token] = self._one_arc(last[i], token)
                        if arc:
                            last[j] = token
                if node >= self._inner:
                    break
        tokens, at = [], len(word)
        while at:
            tokens.append(last[at])
            at -= len(self.labels[last[at]])
        return tokens[::-1]

    def emit(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs one after another."""
        size = self._length[ids]
        total = np.cumsum(size)
        if not len(ids) or not total[-1]:
            return b""
        shift = self._label_start[ids] - (total - size)
        return self._label_bytes[np.repeat(shift, size) + np.arange(total[-1])].tobytes()


def library_encoder(definition: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Words to ids by the tokenizers library.

    Words that begin with a space and have no other are split again at just these spaces,
    so thousands go through the library as one text; its word numbers tell them apart.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    plain = regex.compile(r" [^\s]+")

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, counts = [], np.zeros(len(words), dtype=np.int64)
        joined = [i for i, w in enumerate(words) if plain.fullmatch(w)]
        for k in range(0, len(joined), 4096):
            part = joined[k : k + 4096]
            e = tokenizer.encode("".join([words[i] for i in part]), add_special_tokens=False)
            of = np.array(e.word_ids, dtype=np.int64)
            counts[part] = np.bincount(of, minlength=len(part))
            out.append((np.array(part)[of], np.array(e.ids, dtype=np.uint32)))
        known = set(joined)
        rest = [i for i in range(len(words)) if i not in known]
        for i, e in zip(rest, tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            counts[i] = len(e.ids)
            out.append((np.full(len(e.ids), i), np.array(e.ids, dtype=np.uint32)))
        if not out:
            return np.zeros(0, dtype=np.uint32), counts
        owner, ids = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
        return ids[np.argsort(owner, kind="stable")], counts

    return encode


_SPACE_KIND, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _kinds() -> np.ndarray:
    """Whether each code point is white space, a letter, a number or something else."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for low in (*range(0, 0xD800, 0x1000), *range(0xE000, 0x110000, 0x1000)):
        text = "".join(map(chr, range(low, min(low + 0x1000, 0xD800) if low < 0xD800 else low + 0x1000)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE_KIND, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[low + m.start() : low + m.end()] = kind
    return table


_kind_of: list[np.ndarray] = []


def split_places(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the words of PATTERN begin in the code points of texts that begin at ``texts``.

    Words are runs of letters, of numbers or of other characters with the blank before
    them, and runs of white space without the last character if something follows, which
    is a word of its own unless it is such a blank; an apostrophe without a blank before it
    takes the letters s, t, m, d, re, ve or ll after it.
    """
    if not _kind_of:
        _kind_of.append(_kinds())
    n = len(points)
    kind = _kind_of[0][points]
    begins = np.zeros(n + 1, dtype=bool)
    begins[texts[texts < n]] = True
    word = begins[:n].copy()
    word[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE_KIND
    # the last white space before something, and what follows a blank
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    word[last] = True
    word[last[points[last] == 32] + 1] = False
    p = np.flatnonzero((points[:-1] == 39) & word[: n - 1] & ~begins[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    if len(p):
        padded = np.append(points, [0, 0, 0]).astype(np.int64)
        one = np.isin(padded[p + 1], [ord(c) for c in "stmd"])
        two = np.isin(padded[p + 1] * 0x110000 + padded[p + 2], [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")]) & ~np.append(begins, [True, True])[p + 2]
        word[p[one | two] + 1] = False
        for after in (p[one] + 2, p[two] + 3):
            after = after[after < n]
            after = after[kind[after] == _LETTER]
            word[after] = True
    return np.flatnonzero(word)


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array, half as long again as often as ``size`` values need."""
    room = len(values)
    while room < size:
        room += room >> 1
    return values if room == len(values) else np.concatenate([values, np.zeros(room - len(values), dtype=values.dtype)])


_BLANK = regex.compile(r"(?<=\S)\s")


def cut_at_blanks(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut before white space that follows something else.

    A word of PATTERN ends there whatever comes after, so the pieces' words are the text's.
    """
    at = 0
    while at < len(text):
        m = _BLANK.search(text, at + size) if at + size < len(text) else None
        to = m.start() if m else len(text)
        yield text[at:to]
        at = to


class TextEncoder:
    """Whole texts to ids: pre-split, then each distinct word once by ``encode_words``.

    Words seen before are found by their hash in an open-addressed table and compared
    character by character, up to CACHE_WORDS of them; then the table is emptied, so
    memory stays bounded whatever the corpus.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int]):
        self._encode, self._special = encode_words, special
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self._clear()

    def _clear(self) -> None:
        self._key, self._value = np.zeros(1 << TABLE_BITS, dtype=np.uint64), np.zeros(1 << TABLE_BITS, dtype=np.int32)
        self._ids, self._begin = np.zeros(1 << 18, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64)
        self._characters, self._spelt = np.zeros(1 << 20, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64)
        self._used = self._n = self._length = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those not in the table."""
        slot = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        key = self._key[slot]
        out = np.where(key == h, self._value[slot], -1)
        live = np.flatnonzero((key != h) & (key != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << TABLE_BITS) - 1)
            key = self._key[slot[live]]
            hit = key == h[live]
            out[live[hit]] = self._value[slot[live[hit]]]
            live = live[~hit & (key != 0)]
        return out

    def _store(self, words: list[str]) -> np.ndarray:
        """Encode words and keep their ids and characters; their numbers."""
        flat, counts = self._encode(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self._ids = _grown(self._ids, self._used + len(flat))
        self._characters = _grown(self._characters, self._length + len(points))
        self._begin, self._spelt = _grown(self._begin, self._n + len(words) + 1), _grown(self._spelt, self._n + len(words) + 1)
        self._ids[self._used : self._used + len(flat)] = flat
        self._characters[self._length : self._length + len(points)] = points
        new = np.arange(self._n, self._n + len(words))
        self._begin[new + 1], self._spelt[new + 1] = self._used + np.cumsum(counts), self._length + np.cumsum(sizes)
        self._used, self._length, self._n = self._used + len(flat), self._length + len(points), self._n + len(words)
        return new

    def _add(self, h: np.ndarray, words: list[str]) -> None:
        number = self._store(words)
        slot, live = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.arange(len(h))
        while len(live):
            free = live[self._key[slot[live]] == 0]
            self._key[slot[free]] = h[free]
            won = free[self._key[slot[free]] == h[free]]
            self._value[slot[won]] = number[won]
            done = np.zeros(len(h), dtype=bool)
            done[won] = True
            live = live[~done[live]]
            slot[live] = (slot[live] + 1) & ((1 << TABLE_BITS) - 1)

    def _others(self, at: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words whose characters aren't those of the word found by their hash."""
        size, first = ends - starts, self._spelt[at]
        other = self._spelt[at + 1] - first != size
        kept = np.where(other, 0, size)
        total = np.cumsum(kept)
        stored = self._characters[np.repeat(first - (total - kept), kept) + np.arange(total[-1] if len(total) else 0)]
        own = points if not other.any() else points[np.repeat(~other, size)]
        wrong = np.flatnonzero(stored != own)
        if len(wrong):
            other[np.searchsorted(total, wrong, side="right")] = True
        return np.flatnonzero(other)

    def _portion(self, joined: str, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of these sizes that stand one after another, and how many each has."""
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        starts = split_places(points, begin[:-1])
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        most = min(PORTION_WORDS, (1 << TABLE_BITS) >> 2)
        parts = [self._words(joined, points, starts[i : i + most], ends[i : i + most]) for i in range(0, len(starts), most)]
        ids = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, dtype=np.uint32)
        stop = np.concatenate([[0], np.cumsum(np.concatenate([x for _, x in parts]))]) if parts else np.zeros(1, dtype=np.int64)
        return ids, np.diff(stop[np.searchsorted(starts, begin)]).astype(np.int64)

    def _words(self, joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring words, and how many each has."""
        points = points[starts[0] : ends[-1]]
        h = tiled_hash(points, starts - starts[0])
        h[h == 0] = 1
        at = self._find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self._n + len(new) > min(CACHE_WORDS, (1 << TABLE_BITS) >> 1):
                self._clear()
                new, first = np.unique(h, return_index=True)
                missing = np.arange(len(h))
            place = missing[first]
            self._add(new, [joined[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)])
            at[missing] = self._find(h[missing])
        other = self._others(at, points, starts, ends)
        if len(other):
            at[other] = self._store([joined[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
        size = self._begin[at + 1] - self._begin[at]
        stop = np.cumsum(size)
        ids = self._ids[np.repeat(self._begin[at] - (stop - size), size) + np.arange(int(stop[-1]))]
        return ids, size

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and text ends of texts without special tokens, a portion of them at a time."""
        pieces = [(i, p) for i, t in enumerate(texts) for p in ((t,) if len(t) <= PORTION else cut_at_blanks(t, PORTION))]
        flat, counts, at = [], np.zeros(len(texts), dtype=np.int64), 0
        while at < len(pieces):
            to, size = at + 1, len(pieces[at][1])
            while to < len(pieces) and size + len(pieces[to][1]) <= PORTION:
                size += len(pieces[to][1])
                to += 1
            ids, n = self._portion("".join([p for _, p in pieces[at:to]]), [len(p) for _, p in pieces[at:to]])
            flat.append(ids)
            np.add.at(counts, [i for i, _ in pieces[at:to]], n)
            at = to
        return np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends (with a leading 0)."""
        if self._cut is None or not any(s in t for t in texts for s in self._special):
            return self._plain(texts)
        pieces, of = [], []
        for i, t in enumerate(texts):
            for p in self._cut.split(t):
                pieces.append(p), of.append(i)
        ids, ends = self._plain([p if p not in self._special else "" for p in pieces])
        parts = [np.array([self._special[p]], dtype=np.uint32) if p in self._special else ids[a:b] for p, a, b in zip(pieces, ends, ends[1:], strict=False)]
        sizes = np.bincount(of, weights=[len(p) for p in parts], minlength=len(texts)).astype(np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


_loaded: dict[tuple[int, str], tuple] = {}


def _of(kind: str, definition: str) -> tuple:
    """One encoder for each Python worker and tokenizer file."""
    key = (hash(definition), kind)
    if key not in _loaded:
        if kind == "automaton":
            a = Automaton(definition)
            _loaded[key] = (TextEncoder(a.encode_words, a.special), a)
        else:
            spec = json.loads(definition)
            check_supported(spec)
            _loaded[key] = (TextEncoder(library_encoder(definition), {t["content"]: t["id"] for t in spec.get("added_tokens", ())}), None)
    return _loaded[key]


def encoded_slices(kind: str, definition: str, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, ids, ends) over an Arrow array of texts, some MB of text at a time."""
    encoder, _ = _of(kind, definition)
    _, offsets = buffers(texts)
    for a, b in slices(offsets, SLICE_BYTES):
        ids, ends = encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
        yield a, b, ids, ends


def automaton(definition: str) -> Automaton:
    return _of("automaton", definition)[1]
