"""Words of texts beyond one portion of bytes."""

import random

import numpy as np

from helixframe.llm import common


def test_portions(monkeypatch):
    rng = random.Random(1)
    docs = ["".join(rng.choice("abAB \n\té" * 2 + "x" * 8) for _ in range(rng.choice([0, 1, 5, 40, 300]))).encode() for _ in range(200)]
    data, offsets = np.frombuffer(b"".join(docs), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in docs])])

    def seen(portion, a=0, b=len(docs), lower=False):
        monkeypatch.setattr(common, "PORTION", portion)
        w = common.Words(data, offsets[a : b + 1], lower, 2)
        return w, [x.tolist() for x in (w.starts, w.ends, w.doc, w.first, w.counts, *w.hashes)]

    w, whole = seen(1 << 30)
    words = [(i, x) for i, d in enumerate(docs) for x in d.split()]
    assert [(int(d), w.data[a:b].tobytes()) for d, a, b in zip(w.doc, w.starts, w.ends, strict=True)] == words
    assert len({x for _, x in words}) == len(set(whole[5])) == len(set(zip([x for _, x in words], whole[5], strict=True)))
    for portion in (1, 2, 3, 64, 65, 1000):
        assert seen(portion)[1] == whole and seen(portion, 10, 150, True)[1] == seen(1 << 30, 10, 150, True)[1]


def test_memory_of_a_long_text():
    """A text of 100 MB: what its words take, beyond the text."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np
from helixframe.llm.common import Words
data = np.tile(np.frombuffer(b"abcd efghij klm nopqrst ", dtype=np.uint8), 100_000_000 // 24)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
w = Words(data, np.array([0, len(data)]))
assert len(w.starts) == 4 * (len(data) // 24) and len(set(w.hashes[0][:400].tolist())) == 4
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(common.Path(__file__).resolve().parents[2])).stdout)
    assert used < 1000
