import random

import pytest

from logloom.session import prepare


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    """Workers import the library from where the tests have it."""
    return prepare(spark)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_texts(seed=3, n=60):
    """Texts with nulls, empty ones, white space, copies, a shared passage, a
    long text, letters of several scripts, and one-letter runs."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "straße", "数据", "x", "end.", "O'Neil"]
    say = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(k))
    passage = say(40)
    out = [None, "", "   ", "\n\n", "one", "one two three"]
    for i in range(n):
        text = say(rng.randint(1, 60))
        if i % 4 == 0:
            text = text + " " + passage + "\n" + say(rng.randint(0, 20))
        if i % 9 == 0:
            text = "a" * rng.randint(50, 400)
        if i % 7 == 3:
            text = out[-1]
        if i % 11 == 5:
            text = (out[-2] or "") + "  "
        out.append(text)
    out.append(say(4000))
    return out


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """A stored table of them: several files, repeated rows and ids, null ids,
    and extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(awkward_texts())]
    rows += [rows[10], rows[10], (None, rows[12][1], None, None, None), (None, "only here without an id", None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 as rid", "'x' as slot", "array(1) as found", "2 as h", "true as kept", "'y' as label", "3 as fp", "0 as rank")
    path = str(tmp_path_factory.mktemp("tables") / "documents.parquet")
    table.repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
