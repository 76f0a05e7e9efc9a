from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from prepforge.llm.fragments import from_low_bytes, groups_of, low_bytes
from prepforge.llm.textcore import NOT_ALNUM, SPACE, Words, column_bytes, covered, parts, windows

from .texts import documents


def test_words_equal_the_patterns():
    texts = [t for _, t in documents()]
    data, off = column_bytes(pa.array(texts))
    for table, pattern in ((SPACE, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(data, off, table, True)
        found = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        assert found == [x for t in lower for x in re.findall(pattern, t)]
        assert w.counts.tolist() == [len(re.findall(pattern, t)) for t in lower]


def test_hashes_follow_content_alone():
    a = pa.array(["x yy zzz", "zzz", "yy x yy"])
    data, off = column_bytes(a)
    h = Words(data, off, SPACE, False).hashes()
    assert h[2] == h[3] and h[0] == h[5] and h[1] == h[4] == h[6] and len(set(h.tolist())) == 3
    rows = Words(data, off, SPACE, False).rows
    g, at = windows(h, rows, 2)
    assert at.tolist() == [0, 1, 4, 5]
    assert len(set(g.tolist())) == 3


def test_small_helpers():
    v = np.array([5, 2**39 - 1, 7], np.uint64)
    assert from_low_bytes(low_bytes(v, 5), 5).tolist() == v.tolist()
    order, begin, place = groups_of(np.array([3, 1, 3], np.uint64))
    assert begin.tolist() == [0, 1] and place.tolist() == [0, 1, 1] and order.tolist() == [1, 0, 2]
    assert covered(np.array([1, 2]), 3, 6).tolist() == [False, True, True, True, True, False]
    assert list(parts(np.array([0, 5, 6, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(parts(np.array([0]), 10)) == []
