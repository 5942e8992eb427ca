"""A small awkward table: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random
from collections import namedtuple

SYLLABLES = "an be cor du eth fi gan hol is jo ka lem mi nor ost pra qui ras sel tor u vel wy xan yo zu é ñ".split()
Row = namedtuple("Row", "doc_id text lang source n_chars n_lines score size item_id kept n target class_id")


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def text(rng, lines, words=12):
    return "\n".join(sentence(rng, words) for _ in range(lines))


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, size string, "
          "item_id string, kept string, n string, target string, class_id string")


def rows(seed=3, n=30):
    rng = random.Random(seed)
    texts = [text(rng, rng.randint(1, 8)) for _ in range(n)]
    texts += [None, "", "   \n\t\n", "one", "one two three", texts[0], texts[0] + " more", "\n".join([texts[1], texts[2]]), "a b c d e f g h i j " * 2000,
              "x" * 300_000, texts[3] + "\n" + texts[3]]
    out = [Row(i, t, "en" if i % 2 else None, [None, "s1", "s2", "ß", "src0"][i % 5], None, *"abcdefgh") for i, t in enumerate(texts)]
    out += [out[4], out[4], Row(None, texts[5], None, None, None, *"abcdefgh"), Row(None, None, None, None, None, *"abcdefgh"), Row(7, "another text under a number used before " * 3, None, "s1", None, *"abcdefgh")]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
