import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "tre", "san", "vor", "pel", "qui") for b in ("ra", "ten", "mo", "lis", "du", "gar", "fe", "nox")]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(WORDS) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, None) for i, t, lang, src in rows], DOCS)

    return make


@pytest.fixture()
def folder(tmp_path):
    """A folder of tables: write(name, df) and its path."""

    class Folder:
        path = str(tmp_path)

        @staticmethod
        def write(name, df):
            df.write.parquet(f"{tmp_path}/{name}.parquet")
            return Folder

    return Folder


AWKWARD = [(1, "", "en", "a"), (2, None, "en", "a"), (None, "some words here and there", None, None), (4, "x", "en", "a"), (4, "x", "en", "a"), (5, " \n\t\n ", "de", "b"), (6, "word " * 30_000, "en", "a"), (7, "ünïcödé ☃ 日本語 text\nwith lines\n", "fr", ""), (8, "\x00\x01 odd", "en", "a")]
