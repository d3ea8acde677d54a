"""Tables that hold nothing but null and empty texts: every operator has a row for each."""

import pytest

from loomgraph.llm import kneser_ney, licenses, line_crf, mixing, phrases, pieces, random_indexing, simhash, telephony
from loomgraph.llm.queries import PIECE_MODEL


def labels(spark, label):
    return spark.createDataFrame([(i, i % 2) for i in range(40)], f"doc_id long, {label} int")


def encoded(docs):
    model = pieces.Model.read(PIECE_MODEL)
    return pieces.decode(pieces.encode(docs, model), model)


RUNS = {
    "telephony": telephony.text_media, "line_crf": line_crf.line_quality, "pieces": encoded, "phrases": lambda d: phrases.Repeats(d).report(), "simhash": simhash.near_duplicates,
    "kneser_ney": lambda d: kneser_ney.toxicity(d, labels(d.sparkSession, "toxic")), "mixing": mixing.chances, "licenses": licenses.licenses,
    "random_indexing": lambda d: random_indexing.quality(d, labels(d.sparkSession, "quality")),
}


@pytest.mark.parametrize("name", RUNS)
def test_only_empty_texts(spark, name):
    docs = spark.createDataFrame([(i, [None, ""][i % 2], "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    assert RUNS[name](docs).count() == 40


def test_stages_take_only_empty_texts(spark):
    docs = spark.createDataFrame([(i, [None, ""][i % 2]) for i in range(20)], "doc_id long, text string")
    assert line_crf.kept_documents(docs).count() == 0
    assert [r["doc_id"] for r in simhash.one_of_each(docs).collect()] == [0]
    assert phrases.Repeats(docs).documents().count() == 20
