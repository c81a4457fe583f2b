"""Words of letters, or of letters and one other character, are encoded without a search for their pieces."""

from corvane.llm import bpe
from corvane.llm.queries import vocabulary


class _Counted:
    def __init__(self, pattern):
        self.pattern, self.n = pattern, 0

    def findall(self, text):
        self.n += 1
        return self.pattern.findall(text)


def test_plain_words_need_no_search(monkeypatch):
    words = ["Word", "word.", "a'", "x7", "it's", "a_", "'s", "b", ".", "don't.", "ab\x01", "%%%", "été", "été.", "x" * 3000, "y" * 3000 + "!", "I'LL", "q\x7f"]
    own = bpe.WordBpe(vocabulary())
    counted = _Counted(bpe._SPLIT)
    monkeypatch.setattr(bpe, "_SPLIT", counted)
    for w in words:
        want = own.tokenizer.encode(w, add_special_tokens=False).ids
        assert own[w] == b"".join(i.to_bytes(4, "little") for i in want), w
    before = counted.n
    assert all(own[w] for w in ("Another", "another.", "another'", "another9")) and counted.n == before
