"""Small corpora for the brute-force comparisons."""
import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id string, items string, key string, tag string, spans string, score string, host string"


@pytest.fixture(scope="session")
def corpus():
    """Invented texts: copies, near copies, shared passages, common lines, short and empty texts, one long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 180))]
        if i % 7 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10):]
        if i % 9 == 0 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        for at in range(15, len(words), 16):
            words[at] += "\n"
        if i % 3 == 0:
            words.append("\nShared line of the site.")
        texts.append(" ".join(words))
    texts[10] = texts[3]
    texts[20:24] = ["", " \n\t ", "one", "Two words"]
    texts[30] = " ".join(rng.choice(vocabulary) for _ in range(12_000))
    return texts


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids that occur twice, columns with clashing names."""
    long = "word " * 30_000
    rows = [(1, "A text of the house, with words. " * 20, "en", "s1"), (1, "A text of the house, with words. " * 20, "en", "s1"), (1, "quite another text " * 30, None, None),
            (2, None, "en", "s1"), (None, "A text of the house, with words. " * 20, None, "s1"), (None, None, None, None), (None, "nothing like it " * 25, "fr", None),
            (3, "", "en", "s2"), (4, "   \n\t", "en", "s2"), (5, long, "de", "s2"), (6, "äöü ß 漢字   x y " * 15, "de", "s2"), (7, "x", "en", "s2"), (8, "1234 !!", "en", "s2")]
    return spark.createDataFrame([(i, t, la, s, None, "c", None, "c", "c", "c", "c", "c", "c") for i, t, la, s in rows], COLUMNS)


@pytest.fixture
def documents(spark, corpus):
    """The corpus as a table with ids that are not in order."""
    return spark.createDataFrame([(i * 37 % 1000, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(corpus)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
