"""Small tables for the corpus operators: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.translate(LOWER) if lower else raw)


def table(spark, rows, extra=True):
    """doc_id and text, besides columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        for name in ("score", "fp", "digest", "part", "chunk", "ids", "label", "kept", "n", "component", "held_out"):
            df = df.withColumn(name, F.lit("x"))
    return df


def odd_texts():
    random.seed(5)
    some = ["the cat sat on the mat", "The Cat  sat\ton the mat", "a", "", None, " ", "\n\n", "x\x00y z", "日本語 テスト é ß", "don't stop!!! it's 4.5,6", "a b\nc d\n\ne f "]
    long = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(6000))
    return [*some, long, long, "z" * 5000, "the cat sat on the mat"]


def odd_rows():
    rows = list(enumerate(odd_texts()))
    return [*rows, (3, "a second text of document three"), (None, "a text without a key"), (0, "the cat sat on the mat")]


def prose(n, seed=1, size=120):
    random.seed(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))
    vocabulary = [word() for _ in range(400)]
    return [" ".join(random.choice(vocabulary) for _ in range(random.randint(size // 2, size))) + "." for _ in range(n)]
