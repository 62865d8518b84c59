import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, th long, src string, digest string, node long, pos int, at long, cid long, shard int, lines string, stretch long, `odd name` string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
SAME = " ".join(f"p{i}" for i in range(60))


def edge_rows():
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, LONG), (7, SAME), (8, SAME), (8, SAME), (None, SAME + " tail"),
        (9, "The cat and the dog of the house in a very long street by the river " * 3), (10, "ÉTÉ à la plage et ñandú ### 123"), (11, "###"), (None, None), (12, "a\x0bb\x0cc\r\nd  e"),
        (13, SAME.upper()),
    ]
    extra = ("clash",)
    return [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 2}", None, "r", 1, 2, "x", "y", 3, 4, 5, 6, 7, "l", 8, *extra) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
