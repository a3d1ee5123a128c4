"""Small tables with nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import random

PASSAGE = " ".join(f"shared{i}" for i in range(60))


def rows(seed=3, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    base = prose(300)
    out = [(i, prose(rng.randint(0, 90))) for i in range(n)]
    out += [(100 + i, base.replace(base.split()[7 * i % 90 + 3], word(), 1)) for i in range(8)]  # near copies
    out += [(200 + i, base) for i in range(3)]  # copies
    out += [(300 + i, f"{prose(20)}\n{PASSAGE}\t{prose(9)}") for i in range(4)]
    out += [(400, None), (401, ""), (402, "   \n"), (403, "one"), (404, "one"), (405, "One two three"), (406, "one  two\tthree"), (407, "a " * 3000), (408, "x" * 5000), (409, prose(4000))]
    out += [(None, prose(30)), (None, None), (0, out[0][1]), (1, prose(25)), (410, "\x1c\x1d tabs   and spaces\n\n\nruns  "), (411, "\U0001f600 emoji ¼ ² ǅ 中文 ́")]
    return out


SCHEMA = "doc_id long, text string, size int, shard string, bucket int, slot int, score string, key string, sub string, copy string, block string, of string, a int, b int"


def documents(spark, seed=3, n=40):
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows(seed, n)], SCHEMA).repartition(3)
