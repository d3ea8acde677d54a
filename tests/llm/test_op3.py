import sentencepiece as spm
from sentencepiece import sentencepiece_model_pb2 as schema

from loomgraph.llm import pieces
from loomgraph.llm.queries import PIECE_MODEL, QUERIES
from tests.llm.helpers import ODD, odd_documents, rows, texts

AWKWARD = [
    "", "a", "  two  spaces   and    more", "tab\there\n\nnew", "日本語テキスト 😀 emoji ç", "x" * 500, "  lead", "trail  ", " ", "\n",
    "hello▁world", "ⅷ\u0000 nul", "Ünïcödé wörds straße", "aaaa bbbb aaaaaaaaaaaaa", "http://www.example.com/path?query=1&b=2",
    "don't can't 12345678 3.14159", "internationalization antidisestablishmentarianism", "▁▁ odd", " nbsp　wide",
]


def split(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def test_bpe_ids_equal_the_library(sf_dir):
    model, lib = pieces.Model.read(PIECE_MODEL), spm.SentencePieceProcessor(model_file=PIECE_MODEL)
    for batch in (AWKWARD, list(texts(sf_dir).values()), [t or "" for _, t in ODD]):
        ids, offsets = model.encode(batch)
        assert split(ids, offsets) == lib.encode(batch)
        assert model.decode(ids, offsets) == lib.decode(lib.encode(batch))


def test_unigram_ids_equal_the_library():
    proto = schema.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = -1.0 - (i * 2654435761 % 100003) / 7e3  # no ties
    lib = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = pieces.Model.of([(p.piece, p.score, p.type) for p in proto.pieces], "unigram")
    batch = [t for t in AWKWARD if "  " not in t and "▁▁" not in t] + ["the lowest score wins over many pieces", "Überraschung garçon niño"]
    assert split(*model.encode(batch)) == lib.encode(batch)


def test_query_round_trips(spark, sf_dir):
    got, want = rows(QUERIES["op3_pieces"](spark, sf_dir)), texts(sf_dir)
    assert got.keys() == want.keys() and all(r["round_trip"] and r["n_chars"] == len(want[i]) for i, r in got.items())


def test_odd_rows(spark):
    model = pieces.Model.read(PIECE_MODEL)
    back = rows(pieces.decode(pieces.encode(odd_documents(spark), model), model))
    assert {i: r["decoded"] for i, r in back.items()} == {i: t or "" for i, t in ODD}
    assert back[5]["ids"] == back[6]["ids"] and back[1]["ids"] == []
    assert pieces.encode(odd_documents(spark).limit(0), model).count() == 0


def test_foreign_ids_decode_to_nothing():
    model = pieces.Model.read(PIECE_MODEL)
    import numpy as np

    assert model.decode(np.array([-5, 10**6, 1, 2]), np.array([0, 4])) == [""]


def test_one_pass_equals_two_and_runs_one_worker_a_task(spark, sf_dir):
    model = pieces.Model.read(PIECE_MODEL)
    one, two = pieces.encoded_and_decoded(odd_documents(spark), model), pieces.decode(pieces.encode(odd_documents(spark), model), model)
    assert rows(one) == rows(two) and one.schema == two.schema
    assert pieces.encoded_and_decoded(odd_documents(spark).limit(0), model).count() == 0
    plan = QUERIES["op3_pieces"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
