"""Lines are hashed by the different words of a slice: each is looked up once, ends and case aside."""

import numpy as np
import xxhash

from veilspan.llm import line_dedup as lines


class Counted(lines.LineWords):
    looked = 0

    def __getitem__(self, word):
        self.looked += 1
        return super().__getitem__(word)


def test_words_are_looked_up_once(monkeypatch):
    monkeypatch.setattr(lines, "WORDS", words := Counted())
    text = [f"The {k % 3}th, (the) Line's —  End. ΑΣ. --- x Y12" for k in range(500)] + ["", " \t"]
    at, one, two, simhash, n = lines.line_rows([t.encode() for t in text], 1)
    assert words.looked < 12 and at.tolist() == list(range(500)) and set(n.tolist()) == {7}
    assert len(set(one.tolist())) == len(set(two.tolist())) == 1  # digits are alike in a normal form


def test_simhash_counts_beyond_a_byte():
    plain = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(600)]
    got = lines.line_rows([" ".join(plain + plain[:50]).encode(), b"a b"], 1)[3]
    for want, result in zip((plain, ["a", "b"]), got):
        codes = np.array([xxhash.xxh64_intdigest(w, 3) for w in want], np.uint64)
        ones = [sum(int(c) >> b & 1 for c in codes) for b in range(64)]
        assert int(result) & (1 << 64) - 1 == sum(1 << b for b in range(64) if ones[b] * 2 > len(want))
