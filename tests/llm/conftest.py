import random

import pytest

WORDS = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split(),
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "le de un et à il ne les pas que vous des dans est une ce qui sur se au plus par avec tout faire son mais nous été".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice("abcdefgh") * 2, ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, h, n) rows: copies, near copies, shared passages, nulls, empties, blanks, a long text, repeated rows."""
    rng = random.Random(5)
    rows, base = [], [prose(rng, lang, 120) for lang in ("en", "de", "fr")]
    passage = prose(rng, "en", 60)
    k = 0
    for lang in ("en", "de", "fr"):
        for _ in range(14):
            rows.append((k, prose(rng, lang, rng.randint(1, 150)), lang))
            k += 1
    for b, lang in zip(base, ("en", "de", "fr"), strict=True):
        for j in range(5):
            words = b.split()
            if j > 1:
                words[j * 7] = f"changed{j}"
            rows.append((k, " ".join(words), lang))
            k += 1
    for _ in range(4):
        rows.append((k, prose(rng, "en", 30) + "\n" + passage + "\t" + prose(rng, "en", 25), "en"))
        k += 1
    rows += [(k, None, "en"), (k + 1, "", None), (k + 2, " \t\n", "de"), (k + 3, "one", "en"), (k + 4, "Two words", "en"), (k + 5, "two Words", None), (k + 6, "12 %% 34", "en"), (k + 7, prose(rng, "fr", 9000), "fr")]
    rows += [rows[3], rows[3], (None, "text without an id that is long enough to count", "en"), (k + 8, "naïve café ﬁne 北京 🙂 é\x1cx\xa0y", "fr"), (k + 9, "tail <|endoftext|> </w> it's  a\n\n b ", "en")]
    return [(i, t, lang, None if (i or 0) % 11 == 10 else f"s{(i or 0) % 4}", -1, "x") for i, t, lang in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, h int, n string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")
