"""Tables with everything that operators have to live with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, kept string, text_hash string, key string, label string, held_out string, id string, word string, gone string, size string"


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def docs(spark, extra=(), n=24, seed=1):
    """Plain texts, null, empty, blank and very long ones, repeated rows, equal texts, one id twice, a null id, and columns with the names of helpers."""
    rng = random.Random(seed)
    rows = [(i, text(rng, 60) + "\n" + text(rng, 70), ["en", "fr"][i % 2]) for i in range(n)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, " \t\n\r ", None), (103, text(rng, 40_000), "en"), (104, "a b", None), (105, "a b", "en"), (106, "日本語 🙂 ▁x▁ é\x00", "fr")]
    rows += [rows[0], rows[0], (0, text(rng, 80), "en"), (None, text(rng, 80), "fr"), (None, None, None), (107, rows[1][1], "en"), (108, "x\n" * 3000 + "y", "en")]
    rows += [(d, t, "en") for d, t in extra]
    rng.shuffle(rows)
    tail = ("a",) * 10
    return spark.createDataFrame([(d, t, lang, "s", 1, *tail) for d, t, lang in rows], SCHEMA)


def thue_morse(n, other=False):
    """A word of two letters, or the one with its letters swapped: sums of powers modulo 2**64 cannot tell them apart."""
    return "".join("ab"[(i.bit_count() + other) % 2] for i in range(n))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    import re

    return re.findall("[^\x20\x09-\x0d]+", t or "")
