"""Small tables with odd rows and clashing names, shared by the tests of the corpus operators."""

import random

DOCS = "doc_id long, text string, source string, lang string, size long, label int, fp long, row long"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "en", 7, 1, 3, 4) for i, t, s in rows], DOCS)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
