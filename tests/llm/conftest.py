import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    """Null, empty, blank, very long, tied, repeated and odd texts."""
    rng = random.Random(5)
    vocab = ["word%d" % k for k in range(400)] + ["Über", "naïve", "日本語", "it's", "a|b", "***"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    lines = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(4)]
    texts = [None, "", " \n\t ", "one", "two words", "three small words", "\n\n", "x" * 5000, " ".join(rng.choice(vocab) for _ in range(40_000))]
    base = " ".join(rng.choice(vocab) for _ in range(300))
    texts += [base, base, base.upper(), base.replace("word1 ", "word2 ", 1), base + " tail"]
    texts += [passage + "\nown line " + str(k) for k in range(4)] + ["start\n" + "\n".join(lines[:k]) + "\nend %d" % k for k in (2, 3, 4, 4)]
    texts += ["\n".join(lines[1:]), "\n\n" + lines[0] + "\n\n" + lines[1] + "\n \n", "a b c d e a b c d e a b c d e f", "same line here\nsame line here\n \nother"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 90))) for _ in range(30)]
    texts += ["don't we'll it's they've gone  now\r\n\ttab 123 4567 ½ ٣", "😀😀 é́ \x00\x01   end"]
    return texts


@pytest.fixture(scope="session")
def rows():
    texts = odd_texts()
    out = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    out += [(3, texts[3], "en", "s", 3), (9, texts[9], "fr", "s", 4), (9, "another text with the same id", "fr", "s", 4), (None, "no id at all in here", None, None, None), (None, texts[10], None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
