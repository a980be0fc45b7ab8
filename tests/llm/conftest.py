import os

import pytest


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture
def docs(spark):
    def make(texts, ids=None, **more):
        ids = range(len(texts)) if ids is None else ids
        names = [*more]
        rows = [(i, t, *(more[n][k] for n in names)) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", *(f"{n} string" for n in names)])).repartition(3)

    return make


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables aren't here")
    return path
