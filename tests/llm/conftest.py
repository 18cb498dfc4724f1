import random

import pytest

DOCS = "doc_id long, text string, lang string, h string, _rest int, score string, n_lines string"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (".\n" if r.random() < 0.05 else "") for _ in range(n))


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text), with columns whose names operators use themselves."""
    def docs(rows, parts=3):
        return spark.createDataFrame([(i, t, None, "x", 7, None, "y") for i, t in rows], DOCS).repartition(parts)
    return docs


@pytest.fixture
def odd():
    """Null and empty texts, null ids, repeated rows, a very long text, white space, other scripts."""
    return [(1, None), (2, ""), (3, prose(3, 60)), (3, prose(3, 60)), (None, prose(4, 60)), (None, None), (5, " \t\n\x0b\x0c\r\n"), (6, prose(6, 40_000)),
            (7, "漢字かな交じり文 Ελλάδα    ½ ² ‱ 🙂"), (8, "123 456 !!! \x00\x1c"), (9, "One"), (10, prose(3, 60))]
