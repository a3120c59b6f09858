"""What a Python worker holds between tasks goes when another operator's task begins."""

import gc
import weakref

from quarry.llm import common


class _Cyclic:
    def __init__(self):
        self.memo = common.Memo(self.make, 10)  # as in packing: the memo refers to its maker

    def make(self, word):
        return word


def test_what_another_operator_held_is_freed():
    gc.disable()  # the collector may not come by chance
    try:
        for step in (lambda: common.let_go("b"), lambda: common.held(("b",), object)):
            common.let_go("a")
            gone = weakref.ref(common.held(("a",), _Cyclic))
            common.let_go("a")
            assert gone() is not None  # the same operator keeps it
            step()
            assert gone() is None
    finally:
        gc.enable()


def test_values_of_many_new_words(monkeypatch):
    monkeypatch.setattr(common, "WORDS_AT_ONCE", 3)
    words = common.Words(100, 1, lambda ws: [[float(w)] for w in ws])
    number = words.numbers([b"5", b"1", b"9", b"5", b"2", b"7", b"8", b"4"])
    assert words.table[number, 0].tolist() == [5, 1, 9, 5, 2, 7, 8, 4]
