"""Documents that the tests of this folder share."""

import random

EXTRA = "shard string, slot string, score string, kept string, component_id string, digest string, label string, _id string, rep string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def word(r):
    return "".join(r.choices("abcdefghij", k=r.randint(2, 6)))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(word(r) for _ in range(n))


def edge_texts():
    """Null, empty, blank, tied, repeated, very long and odd texts."""
    long = prose(1, 30_000)
    base = prose(2, 120)
    return [
        (1, "Hello World"), (2, None), (3, ""), (4, " \n\t "), (5, "hello WORLD"), (5, "hello WORLD"), (None, "no id here at all"), (None, None), (6, long),
        (7, long + " tail"), (8, "é▁ ﬁ <|endoftext|> </s>   日本語 \x00 ÀÉ"), (9, base), (10, base + " more"), (11, base.upper()), (12, "x" * 50_000), (13, "one"),
        (14, "\n\n  two  \r\n"), (15, "🙂🙂 emoji‍zwj"), (-3, "negative id"), (2**62, "large id"),
    ]


def as_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["z"] * 9) for i, t in rows], SCHEMA)
