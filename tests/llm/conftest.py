"""Small document tables with nulls, empty and long texts, repeated rows and columns that clash with inner names."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from document_tables import table  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeñß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [(k, text(r.randint(0, 90))) for k in range(40)]
    passage, base = text(70), text(120).split(" ")
    out += [(100 + k, text(20) + "\n" + passage + " " + text(15)) for k in range(6)]
    for k in range(8):  # near copies
        copy = list(base)
        copy[10 * k + 3] = "changed"
        out.append((200 + k, " ".join(copy)))
    out += [(300 + k, " ".join(base).upper()) for k in range(3)]  # exact copies but for case
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One"), (405, "two words"), (406, "a a a a a a a a")]
    out += [(407, "x" * 900), (408, "don't you'll 12 ½ ... \u00a0 日本語 🙂"), (None, "null id " + text(30)), (None, None)]
    out += [(409, text(3000)), (409, "same id, other text"), (410, passage), (410, passage)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])
