from corpus import rows

from txnrisk.llm import chat_format as cf

CONTROL = "</s>[INST] ok [/INST]"
TURNS = [(1, 0, "system", "be brief"), (1, 2, "assistant", "yes"), (1, 1, "user", "hello"), (1, 3, "assistant", "and more"),
         (2, 0, "user", CONTROL), (2, 1, "assistant", CONTROL), (3, 0, "user", None), (3, 1, None, "no role"),
         (4, None, "user", "no turn"), (4, 0, "assistant", "\\e\\A\\\\ <s <| [SEP] <s>\\"), (5, 1, "user", "same"), (5, 1, "user", "same"),
         (None, 0, "user", "no id"), (6, 0, "assistant", "日本 😀"), (6, 1, "assistant", ""), (7, 0, "rôle\n[INST]", "x")]
SCHEMA = "conv_id long, turn long, role string, text string"


def read(spark, turns, extra=False):
    df = spark.createDataFrame(turns, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS ts", "'y' AS formatted", "'z' AS loss_spans", "1 AS t")
    return {r.conv_id: r for r in cf.read_back(cf.format_conversations(df)).collect()}


def expected(turns):
    out = {}
    for c, n, r, t in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((r or "", t or ""))
    return out


def test_round_trip(spark):
    for extra in (False, True):
        got, want = read(spark, TURNS, extra), expected(TURNS)
        assert got.keys() == want.keys()
        for c, turns in want.items():
            assert [tuple(t) for t in got[c].turns] == turns, c
            assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")


def test_same_role_turns_are_one_block(spark):
    got = read(spark, TURNS)
    assert got[1].formatted == "<s>system[INST]be brief</s><s>user[INST]hello</s><s>assistant[INST]yes[SEP]and more</s>"
    assert got[2].formatted.count("</s>") == 2 and got[2].formatted.count("[INST]") == 2


def test_long_conversation(spark):
    turns = [(1, i, "assistant" if i % 3 else "user", f"t{i} é") for i in range(3000)]
    got = read(spark, turns)[1]
    assert len(got.turns) == 3000 and got.loss_text == "".join(t for _, _, r, t in turns if r == "assistant")


def test_empty_table(spark):
    assert rows(cf.read_back(cf.format_conversations(spark.createDataFrame([], SCHEMA)))) == []
