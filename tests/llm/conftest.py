import random

import pytest

WORDS = "the of and museum park train child story river light green paper music stone water garden bridge winter summer market school window yellow animal dinosaur planet rocket forest castle island".split()


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and columns whose names the operators use inside."""
    long_text = sentence(1, 20_000)
    rows = [
        (1, sentence(2, 120)), (2, sentence(2, 120)), (3, None), (4, ""), (5, "   \n\t "), (6, long_text), (6, long_text), (7, sentence(3, 60)), (7, sentence(4, 60)),
        (None, sentence(2, 120)), (None, None), (8, "one two three"), (9, "One, TWO three!"), (10, "é 中文 ́ 😀 <|endoftext|> x" * 30), (11, "\x00 nul ퟿ end"), (12, sentence(2, 119) + " changed"),
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t), 0, "n", "k", 1.0, "x", 5) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash long, node string, key string, score double, gone_id string, dirty_id long").repartition(3)


@pytest.fixture(scope="session")
def no_documents(awkward):
    return awkward.limit(0)


@pytest.fixture
def shuffles(monkeypatch):
    """Nothing is small enough for a broadcast: the other side of the operators' size checks."""
    monkeypatch.setattr("townkit.llm.shared.BROADCAST_BYTES", -1)
