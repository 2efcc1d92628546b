import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rid long, _rid string, h long, n long, key string"


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(" ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(4, 9))).capitalize() + "." for _ in range(sentences))


def rows() -> list[tuple]:
    """Null, empty and long texts, ties, copies, near copies, a repeated row, null in every column."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 30)) for _ in range(30)]
    long = prose(rng, 400)
    near = [" ".join(w if k != i else "changed" for k, w in enumerate(long.split())) for i in (10, 200, 900)]
    texts = [*base, base[0], base[0] + " \n", "  " + base[1], None, "", " \t\n", "x", "x x", long, *near, "no letters 123", "12 34", "ünïcode ß 日本 🙂"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[3], (None, base[2], None, None, None), (None, None, None, None, None)]
    return [(*r, f"x{k}", k, "y", 7, None, "z") for k, r in enumerate(out)]


@pytest.fixture(scope="session")
def raw():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(raw, SCHEMA).repartition(3, "rid").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
