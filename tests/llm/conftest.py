import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160, seed=5):
    """Texts with copies, near copies, shared passages, repeated lines, nulls, blanks, repeated rows, long lines."""
    rnd = random.Random(seed)
    words = {"en": "the of and that with river stone house bright water under".split(), "de": "der und nicht fluß stein haus über wasser größe schön".split()}
    passage = " ".join(rnd.choices(words["en"], k=40))
    rows, texts = [], []
    for i in range(n):
        lang = rnd.choice(["en", "de"])
        kind = rnd.random()
        if kind < 0.12 and texts:
            t, lang = rnd.choice(texts)
        elif kind < 0.24 and texts:
            t, lang = rnd.choice(texts)
            t += " " + rnd.choice(words[lang])
        else:
            t = "\n".join(" ".join(rnd.choices(words[lang], k=rnd.randint(1, 12))) + "." for _ in range(rnd.randint(1, 9)))
            if kind > 0.85:
                t += "\n" + passage + "\nend\nof it\n"
        texts.append((t, lang))
        rows.append((i, t, lang, rnd.choice(["a", "b", "c", None]), len(t)))
    rows += [(n, None, "en", "a", None), (n + 1, "", "en", "b", 0), (n + 2, "  \t\n", None, None, 4), (n + 3, "12 %% 34", "en", "a", 8), rows[3], rows[3]]
    rows += [(n + 4, ("word " * 30_000) + "end", "en", "a", 150_003), (None, "a text without an id, but with words", "en", "a", 36)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The corpus without its one long text, for slow plain versions."""
    return [r for r in corpus() if len(r[1] or "") < 10_000]
