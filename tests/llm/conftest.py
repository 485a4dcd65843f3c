import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall(text or "")


def lowered(text):
    return words((text or "").translate(LOWER))


def corpus(seed=5):
    """(doc_id, text, lang, source, n_chars): random texts, exact and near copies, a shared passage, repeats, and odd ones."""
    r = random.Random(seed)
    vocabulary = {lang: ["".join(r.choice(chars) for _ in range(r.randint(2, 7))) for _ in range(400)] for lang, chars in (("en", "abcdefgh"), ("fr", "éèçijkla"), ("de", "äößmnopq"))}

    def text(lang, n):
        return " ".join(r.choice(vocabulary[lang]) for _ in range(n))

    rows, passage = [], text("en", 60)
    for i in range(60):
        lang = ("en", "fr", "de")[i % 3]
        body = text(lang, r.randint(1, 160))
        rows.append((body + (" " + passage + " end" if i % 7 == 0 else ""), lang))
    base = text("en", 120).split()
    for i in range(14):
        copy = list(base)
        for _ in range(i % 5):
            copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
        rows.append((" ".join(copy).upper() if i % 6 == 0 else "\n".join(copy), "en"))
    rows += [(rows[3][0], "en")] * 3 + [(None, None), ("", "en"), ("   \n\t", None), ("123 456 ###", "en"), ("one", "en"), ("a b c d e", "en"), ("loop " * 90, "en"), ("é" * 3000, None), ("x" * 5000 + " y", "en")]
    return [(i * 3, t, lang, None if i % 11 == 0 else f"s{i % 4}", len(t) if t is not None else None) for i, (t, lang) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture(scope="session")
def frame(spark, docs):
    """The corpus with a null id, a repeated row and columns whose names clash with those that operators use."""
    rows = [(*r, "x", 1, 2) for r in [*docs, docs[5]]] + [(None, "null id text here", "en", "s1", 17, "y", 3, 4)]
    return spark.createDataFrame(rows, SCHEMA + ", score string, node int, key int").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
