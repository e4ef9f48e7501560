"""Tables with everything that operators must survive."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, start string, class int, kind string, shard string, wanted string"


def frame(spark, rows):
    """rows: (doc_id, text). The other columns clash with names used inside operators."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, "k", "s", "w") for i, t in rows], SCHEMA)


def empty(spark):
    return frame(spark, [])


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "some text of nobody"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "日本語 text ünïcode"), (6, "!!! ... ###")]


#: Names that ``keep_one`` and ``cut`` would use for columns of their own.
HIDDEN = ("__key", "__key_id", "__KEY_NULL", "__state", "__nth", "__cuts", "__cut_id", "__cut_hash", "a.b")


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit(name) for name in HIDDEN})
