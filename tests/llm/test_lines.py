"""Line IDs of op6: texts of a batch are read together, and tidy lines aren't split into words; what comes out is as line by line."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from cloakwork.llm import lines as L

PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", "　", "​", "a", "b c", "x y z w v", "日本", "ไทยไทย", "\ud800", "é", "—", "\x00"]


def test_lines_of_a_batch_are_as_line_by_line():
    rnd = random.Random(1)
    for _ in range(50):
        some = rnd.sample(PIECES, rnd.randint(2, 8))
        texts = [None, "", *("".join(rnd.choice(some) for _ in range(rnd.randint(0, 20))) for _ in range(50))]
        full = [[x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")] for t in texts]
        ids, content, first, n = L._lines(texts, True)
        assert n.tolist() == [len(x) for x in full] and first.tolist() == np.cumsum([0, *n[:-1]]).tolist()
        flat = [x for lines in full for x in lines]
        assert ids.tobytes() == b"".join(xxhash.xxh3_128_digest(" ".join(x.split()).encode("utf-8", "surrogatepass")) for x in flat)
        assert content.tolist() == [len(x.split()) >= 5 or not x.isascii() and len(x.split()) + len(L.NO_BLANKS.findall(x)) // 2 >= 5 for x in flat]


def test_every_blank_makes_a_text_untidy():
    blanks = [c.encode() for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n"]
    assert len(blanks) > 20 and all(any(x in c for x in (*L.UNTIDY, *L.UNTIDY_WIDE)) for c in blanks)


def test_places_of_a_sliced_batch():
    lists = pa.array([[{"k": 9, "later": True}], [{"k": 0, "later": False}, {"k": 2, "later": True}], [], [{"k": 1, "later": True}]]).slice(1)
    row, k, later = L._places(lists, "k", "later")
    assert row.tolist() == [0, 0, 2] and k.tolist() == [0, 2, 1] and later.tolist() == [False, True, True]
