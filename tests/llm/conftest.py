import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts():
    """Invented documents: near copies, exact copies, shared lines, odd spacing, nulls and empty texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    base = [[word() for _ in range(r.randint(1, 90))] for _ in range(30)]
    out = []
    for k, w in enumerate(base):
        out.append(" ".join(w))
        for _ in range(r.randint(0, 5)):
            own = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                own[r.randrange(len(own))] = word()
            out.append(r.choice([" ", "  ", "\n"]).join(own).upper() if r.random() < 0.2 else " ".join(own))
    line = "This line is shared by very many documents of the table, É too"
    out = [t + ("\n " + line.upper() if k % 3 == 0 else "\n" + line + "\t" if k % 3 == 1 else "") for k, t in enumerate(out)]
    out += [None, "", " \n\t", "one", "One", "a b c", "A  B\nC", "#" * 3000, "x " * 4000]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, [1.5]) for i, t in texts], "doc_id long, text string, family string, n_lines int, score array<double>")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
