import random

import pytest


def make_texts() -> list[str | None]:
    """Nasty texts: null, empty, white space, one word, ties, copies, near copies, odd characters, a very long one."""
    rng = random.Random(4)
    syllables = ["the", "an", "der", "que", "lo", "x", "ment", "ción", "ß", "é"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    base = [word() for _ in range(400)]
    texts: list[str | None] = [None, "", "  \t\n", "word", "Word", "a b c d", "a b c d e", "1234 !!! ???", "<|endoftext|> A<|STARTOFTEXT|>b", "a b　c d", "naïve café — ünïcode ☃ \U0001f600 日本語 العربية", "it's we'll I'd 'tis ''s", "\x1c\x85  line"]
    for _ in range(6):
        near = list(base)
        for at in rng.sample(range(len(near)), 6):
            near[at] = word()
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 3 + [" ".join(base).upper()]
    for _ in range(40):
        texts.append(" ".join(word() for _ in range(rng.randint(1, 60))) + ". ")
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(20)]
    texts.append(" ".join(word() for _ in range(30_000)))
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows (doc_id, text, lang, source, n_chars) and columns whose names the operators use themselves; one row twice, one without an id."""
    langs, sources = ["en", "fr", None], ["a", "B", None, "é", "b"]
    rows = [(i, t, langs[i % 3], sources[i * i % 5], len(t or ""), f"x{i}", 1.5, i) for i, t in enumerate(texts)]
    rows.append(rows[20])
    rows.append((None, "no id here at all", "en", "a", 17, "x", 0.5, 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, size long"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
