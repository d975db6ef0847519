from __future__ import annotations

from collections import Counter
from pathlib import Path


def test_test_modules_have_names_of_their_own():
    """The folders are no packages: two modules of one name would hide each other."""
    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert [n for n, count in names.items() if count > 1] == []
