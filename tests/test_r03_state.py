"""Rows of a key come sorted, in lists of a bounded length."""

import pandas as pd

from siftline.streaming import stateful


def test_rows_come_in_lists(monkeypatch):
    monkeypatch.setattr(stateful, "ROWS_HELD", 4)
    frames = [pd.DataFrame({"at": [5, 3, 5], "id": [2, 9, 1], "what": ["a", "b", "c"]}), pd.DataFrame({"at": [1, 2, 9, 3], "id": [4, 5, 6, 7], "what": ["d", "é", "", "g"]})]
    got = list(stateful._sorted_rows(iter(frames)))
    assert [len(x) for x in got] == [4, 3]
    assert sum(got, []) == [(1, 4, "d"), (2, 5, "é"), (3, 7, "g"), (3, 9, "b"), (5, 1, "c"), (5, 2, "a"), (9, 6, "")]
