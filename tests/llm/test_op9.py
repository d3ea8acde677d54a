import duckdb
import numpy as np

from loomgraph.llm import chat
from loomgraph.llm.common import buffers
from loomgraph.llm.queries import ORACLES, QUERIES

HARD = [
    "", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\|end|>", "<|turn|>user\nhi<|end|>\n", "<<SYS>> x <</SYS>>", "<<|end|>", "[[INST]]", "\\", "é 😀 <s>\n\n", "a<", "|end|>", "<|im_start|><|im_end|><|endoftext|>",
]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = sorted(con.sql(ORACLES["op9_chat_assembly"]).fetchall())
    df = QUERIES["op9_chat_assembly"](spark, sf_dir)
    assert df.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, df.collect())) == want


def test_hard_texts_and_roles_round_trip(spark):
    roles = ["user", "assistant", "system", "odd\nrole", "back\\slash", "<|end|>", None]
    rows, want = [], {}
    for c in range(40):
        turns = [(roles[(c * 7 + k) % len(roles)], HARD[(c + k * 3) % len(HARD)]) for k in range(c % 9 + 1)]
        want[c] = turns
        rows += [(c, k, r, t, "clash") for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    for r in chat.formatted(df).collect():
        turns = [(role or "", text) for role, text in want[r["conv_id"]]]
        assert chat.parsed(r["formatted"]) == turns and r["n_turns"] == len(turns)
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert [chat.unescaped(s) for s in spans] == [t for role, t in turns if role == "assistant"]
        inner = r["formatted"].replace("<|turn|>", "").replace("<|end|>\n", "")
        assert not any(not m[2] for m in chat.CONTROL.finditer(inner.encode()))
        assert r["formatted"].count("<|turn|>") == r["formatted"].count("<|end|>") == r["n_turns"]


def test_neighbouring_texts_do_not_make_control_strings():
    data = np.frombuffer(b"a<|end|>", np.uint8)
    for cut in range(1, 8):
        out, offsets = chat.escaped(data, np.array([0, cut, 8]))
        assert len(out) == (9 if cut == 1 else 8) and offsets[-1] == len(out)


def test_nulls_ties_and_one_long_conversation(spark):
    rows = [(None, 1, "user", None), (None, None, None, "x"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    rows += [(9, k, "assistant", f"turn {k} ") for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chat.parsed(got[None]["formatted"]) == [("", "x"), ("user", "")]
    assert chat.parsed(got[5]["formatted"]) == [("user", "same")] * 2
    assert chat.parsed(got[9]["formatted"]) == [("assistant", f"turn {k} ") for k in range(3000)]
    assert [got[9]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[9]["loss_spans"]] == [f"turn {k} " for k in range(3000)]
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chunks_of_a_long_conversation(spark):
    """A conversation of many chunks reads back as it does in one row, in order or dealt anew."""
    rows = [(c, k, ["assistant", "user"][k % 2], f"turn {k} é " * (k % 5 + 1)) for c in (3, None, 4) for k in range(700 if c == 3 else 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        cut = chat.formatted(df, chunk_bytes=2000).cache()
        whole = sorted(map(str, chat.read_back(chat.formatted(df), in_order=True).collect()))
        assert {r["conv_id"]: r["n"] for r in cut.selectExpr("conv_id", "chunk").groupBy("conv_id").agg({"chunk": "max"}).toDF("conv_id", "n").collect()}[3] > 3
        assert sorted(map(str, chat.read_back(cut.orderBy("chunk")).collect())) == whole
        assert sorted(map(str, chat.read_back(chat.formatted(df, chunk_bytes=2000), in_order=True).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_column_is_the_assembled_array():
    import pyarrow as pa

    part = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array(["user", "assistant", "user"]), pa.array(["a", "b", "c"])], names=["conv_id", "role", "text"])
    first, rows = chat._segments(part, ("assistant",))
    out, at, _, _ = chat.assembled(["user", "assistant", "user"], *buffers(part.column(2)))
    assert first == [0, 2] and rows.column(2).buffers()[2].size == len(out) and rows.column(2).to_pylist() == [out[at[0] : at[2]].tobytes().decode(), out[at[2] :].tobytes().decode()]
