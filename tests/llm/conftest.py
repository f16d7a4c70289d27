import random

import pytest


@pytest.fixture
def shared(spark, tmp_path):
    """A shared folder of its own for the intermediate tables."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    return spark.sparkContext.getCheckpointDir()


@pytest.fixture
def words():
    """Made-up sentences from a seed."""
    def text(seed: int, n: int, vocabulary: int = 400) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return text
