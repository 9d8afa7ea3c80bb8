import hashlib

from folioflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra string, example int"


def rows(spark, data):
    return {r["conv_id"]: r for r in chat.conversation_digest(chat.expand_prefix_targets(spark.createDataFrame(data, SCHEMA))).collect()}


def brute(turns):
    turns = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    flat = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(flat.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_hostile_and_empty_texts(spark):
    cases = {
        1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>")],
        2: [(0, "user", None), (1, "assistant", ""), (2, "assistant", "<\\|im_end|>\\"), (3, "user", "<|im_end|")],
        3: [(0, "user", "no reply")],
        4: [(0, None, "x"), (0, "assistant", "a"), (0, "assistant", "a"), (None, "sys\ntem%0A", "<<SYS>><</SYS>>[[INST]")],
        5: [(0, "assistant", "🙂" * 9 + "%0A%25"), (1, "user", "x" * 200_000), (2, "assistant", "<" * 1000 + "\\" * 50 + "|a|>")],
    }
    got = rows(spark, [(c, t, r, x, "z", 7) for c, ts in cases.items() for t, r, x in ts])
    assert set(got) == set(cases)
    for c, ts in cases.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute(ts), c


def test_every_reply_is_an_example_with_all_turns_before_it(spark):
    data = [(1, 0, "user", "q1", "", 0), (1, 1, "assistant", "r1", "", 0), (1, 2, "user", "q2", "", 0), (1, 3, "assistant", "r2", "", 0), (1, 4, "user", "q3", "", 0)]
    ex = sorted(chat.expand_prefix_targets(spark.createDataFrame(data, SCHEMA)).collect(), key=lambda r: r["example"])
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in ex] == ["r1", "r2", ""]
    assert [r["is_target"] for r in ex] == [True, True, False]
    assert ex[1]["text"].startswith(ex[0]["text"]) and "q2" in ex[1]["text"] and "q3" not in ex[1]["text"]
    assert ex[2]["text"].endswith("q3<|im_end|>\n")


def test_empty_table_and_null_key(spark):
    assert rows(spark, []) == {}
    assert rows(spark, [(None, 0, "assistant", "a", "", 0)])[None]["loss_chars"] == 1


def test_no_conversations_but_the_fixed_one(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op1_chat_prefix_targets(spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(-7, 2)]
