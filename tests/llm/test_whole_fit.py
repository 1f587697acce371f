"""The latent space comes from every document, not from a sample of ids."""

import numpy as np

from pagegrain.llm import decontaminate


def test_rows_without_an_id_count_in_the_fit(spark):
    texts = [f"word{n} other{n % 3} third{n % 5} same thing again" for n in range(20)]
    named = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "doc_id long, text string").coalesce(1)
    nameless = spark.createDataFrame([(None, text) for text in texts], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "one benchmark item of more than eight words in all")], "item_id long, text string")
    one, other = decontaminate.fit(named, items, rank=4), decontaminate.fit(nameless, items, rank=4)
    assert np.allclose(one.idf, other.idf)
    assert np.allclose(one.projection @ one.projection[0], other.projection @ other.projection[0], atol=1e-3)
