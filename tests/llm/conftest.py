import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DDL = "doc_id long, text string, lang string, source string, n_chars long, row_key string, llm_doc int, n_lines string, kept boolean, fp string"


def rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids, near copies, rare blanks."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["th", "er", "on", "é", "ing", "ß", "A"]) for _ in range(draw.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    shared = "A line that several documents hold, word for word.\n"
    out = [(None, passage), (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, passage), (6, passage + " end"), (6, passage + " end"), (6, "another text of six " + passage)]
    out += [(7, shared * 3 + "tail"), (8, "  " + shared.upper() + "own\ttext\x0bhere\r\n\n"), (9, shared + passage[:200]), (10, " ".join(word() for _ in range(40_000))), (11, "x" * 200_000)]
    out += [(12 + k, " ".join(word() for _ in range(80)) + "\n" + shared) for k in range(10)]
    out += [(30 + k, passage + " " + passage + " " + word()) for k in range(5)]
    return out


@pytest.fixture(scope="session")
def cases():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame([(i, t, None, "src" if (i or 0) % 3 else None, None if t is None else len(t), "k", 1, "n", None, "f") for i, t in cases], DDL).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
