import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def table(spark):
    """Rows (doc_id, text) or longer ones as documents."""

    def make(rows, schema=None):
        schema = schema or DOCS
        width = schema.count(",") + 1
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared lines, empty ones, and a null; by seed."""

    def make(seed, n=60):
        rng = random.Random(seed)
        words = ["the", "Of", "né", "über", "x1", "don't", "ab", "zu", "mañana", "漢字", "ok,", "A."]
        shared = " ".join(rng.choices(words, k=18))
        texts = [None, "", " ", "\n\n", "a", "ab " * 400, "no-spaces" * 300]
        while len(texts) < n:
            kind = rng.random()
            if kind < 0.2:
                texts.append(rng.choice(texts))
            elif kind < 0.4 and texts[-1]:
                cut = rng.randrange(len(texts[-1]) + 1)
                texts.append(texts[-1][:cut] + rng.choice(words) + texts[-1][cut:])
            else:
                lines = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
                if rng.random() < 0.5:
                    lines.insert(rng.randrange(len(lines) + 1), rng.choice([shared, shared.upper(), "  " + shared]))
                texts.append("\n".join(lines))
        return list(enumerate(texts))

    return make
